"""Linking of names and addresses against the rule applied to every pair."""

import random

from pyspark.sql import functions as F

from maskwright.operators import link

KEY = b"0123456789abcdef"
SCHEMA = "doc_id string, container_id string, entity_type string, start int, end int, text string"


def entities(seed):
    rnd = random.Random(seed)
    firsts, lasts = ["Ann", "Al", "A", "Bob", "Bo", "Straße", "Zoë"], ["Lee", "Leeds", "Ann", "O", "Vance", "van Dyke", "Lee2", "Strasse"]
    rows = []
    for k in range(400):
        place = (f"d{rnd.randrange(9)}", f"body/t0000/r000{rnd.randrange(4)}/c000{rnd.randrange(2)}/p0000")
        first, last = rnd.choice(firsts), rnd.choice(lasts)
        if rnd.random() < 0.5:
            rows.append((*place, "PERSON", k, k + 1, rnd.choice([f"{first} {last}", f"{first} M. {last}", f"{last}", first + "x" * rnd.randrange(3) + " " + last])))
        else:
            local = rnd.choice([f"{first}.{last}", f"{first[0]}{last}", f"{last}_{first}", f"x{first}9{last}y", first, "", "a" * 70 + last, f"{first[0]}{last}{k}"])
            rows.append((*place, "EMAIL", k, k + 1, local.replace(" ", "") + rnd.choice(["@x.org", "@Ann.lee", ""])))
    rows += [("n", "c", "PERSON", 1, 2, None), ("n", "c", "EMAIL", 3, 4, None), (None, "c", "PERSON", 1, 2, "Ann Lee"), (None, "c", "EMAIL", 3, 4, "ann.lee@x.org"), ("n", "c", "EMAIL", 5, 6, "ann.lee@x.org"), ("n", "c", "PERSON", 7, 8, "Ann Lee")]
    return rows + [("t", "c", "PERSON", 1, 2, "Ann Lee"), ("t", "c", "PERSON", 1, 2, "Ann Lee"), ("t", "c", "EMAIL", 3, 4, "ann.lee@x.org"), ("u", "c", "PERSON", 1, 2, "Ann Lee"), ("u", "c", "EMAIL", 3, 4, "al@x.org"), ("u", "c", "EMAIL", 5, 6, "alee@x.org")]


def test_linked_as_by_every_pair_but_without_making_them(spark):
    rows = entities(3) + entities(4)[:-9]
    df = spark.createDataFrame(rows, SCHEMA)
    linked = link.link(df, KEY)
    assert len(rows) == linked.count()
    key = lambda r: (r["doc_id"], r["container_id"], r["entity_type"], r["start"], r["end"])
    groups = {}
    for r in linked.where("link_scope = 'identity'").collect():
        groups.setdefault((r["doc_id"], r["identity_key"]), set()).add(key(r))
    here = df.withColumn("context", link.context_key(F.col("container_id")))
    every = here.where("entity_type = 'PERSON'").alias("p").join(here.where("entity_type = 'EMAIL'").alias("m"), (F.col("p.doc_id") == F.col("m.doc_id")) & (F.col("p.context") == F.col("m.context")) & link.mail_fits_name(F.col("m.text"), F.col("p.text")))
    pairs = [(key(r["p"]), key(r["m"])) for r in every.select(F.struct("p.*").alias("p"), F.struct("m.*").alias("m")).collect()]
    people, mails = [p for p, _ in pairs], [m for _, m in pairs]
    wanted = {x for p, m in pairs if people.count(p) == 1 and mails.count(m) == 1 for x in (p, m)}
    assert len(wanted) > 20 and set().union(*groups.values()) == wanted
    plan = linked._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" not in plan and "StartsWith(" not in plan
