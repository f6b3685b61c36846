"""Identity linking: a person and an address of mail that only fit each other, within one local context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import context_key, folded, hmac_sha256

KEYS = ["doc_id", "container_id", "entity_type", "start", "end"]


def name_tokens(name: Column) -> Column:
    return F.regexp_extract_all(folded(name), F.lit("[a-z]+"), F.lit(0))


def local_part(mail: Column) -> Column:
    return F.regexp_replace(folded(F.substring_index(mail, "@", 1)), "[^a-z0-9]", "")


def mail_fits_name(mail: Column, name: Column) -> Column:
    """The local part holds the first and the last name, or starts with the first's initial and the last."""
    local = local_part(mail)
    tokens = name_tokens(name)
    first, last = F.get(tokens, F.lit(0)), F.get(tokens, F.size(tokens) - 1)
    return (F.size(tokens) >= 2) & ((F.contains(local, first) & F.contains(local, last)) | F.startswith(local, F.concat(F.substring(first, 1, 1), last)))


def _fitting(people: DataFrame, mails: DataFrame) -> DataFrame:
    """doc_id, __context, first, last, local of all names and local parts that fit, as mail_fits_name has it.

    Equal keys alone are joined: the pieces of a local part with the first and the last
    names of its context, its beginnings with initials and last names. What a local part
    gives depends on its own length, not on how many names and addresses there are.
    """
    here = ["doc_id", "__context"]
    longest = people.groupBy(*here).agg(F.max(F.greatest(F.length("first"), F.length("last"))).alias("longest"))
    locals_ = mails.where("local <> ''").join(longest, here)
    pieces = F.expr("array_distinct(flatten(transform(sequence(1, length(local)), i -> transform(sequence(1, least(longest, length(local) - i + 1)), n -> substring(local, i, n)))))")
    each = locals_.select(*here, "local", F.explode(pieces).alias("piece"))
    of = lambda name: each.join(people.select(*here, F.col(name).alias("piece")).distinct(), [*here, "piece"]).select(*here, "local", F.col("piece").alias(name))
    both = of("first").join(of("last"), [*here, "local"]).join(people, [*here, "first", "last"])
    starts = locals_.select(*here, "local", F.explode(F.expr("transform(sequence(1, least(longest + 1, length(local))), n -> substring(local, 1, n))")).alias("start"))
    begun = starts.join(people.withColumn("start", F.concat(F.substring("first", 1, 1), "last")), [*here, "start"])
    names = [*here, "first", "last", "local"]
    return both.select(*names).union(begun.select(*names)).distinct()


def link(entities: DataFrame, secret: bytes) -> DataFrame:
    """entities with identity_key and link_scope: both set on pairs that are unique from either side, null elsewhere.

    Names of the same first and last token, and addresses of the same local part, are
    counted before they meet, so that many of them don't make many pairs.
    """
    if len(secret) < 16:
        raise ValueError("the secret must have 16 bytes at least")
    here = entities.withColumn("__context", context_key(F.col("container_id")))
    tokens = name_tokens(F.col("text"))
    named = here.where("entity_type = 'PERSON'").select("doc_id", "__context", tokens.alias("tokens"), F.struct(*KEYS).alias("person")).where(F.size("tokens") >= 2)
    side = named.select("doc_id", "__context", F.get("tokens", F.lit(0)).alias("first"), F.get("tokens", F.size("tokens") - 1).alias("last"), "person", "tokens")
    people = side.groupBy("doc_id", "__context", "first", "last").agg(F.count("*").alias("people"), F.first(F.struct("person", "tokens")).alias("p"))
    mails = here.where("entity_type = 'EMAIL'").select("doc_id", "__context", local_part(F.col("text")).alias("local"), F.struct(*KEYS).alias("address"))
    mails = mails.groupBy("doc_id", "__context", "local").agg(F.count("*").alias("mails"), F.first("address").alias("address"))
    pairs = _fitting(people.select("doc_id", "__context", "first", "last"), mails.select("doc_id", "__context", "local"))
    pairs = pairs.join(people, ["doc_id", "__context", "first", "last"]).join(mails, ["doc_id", "__context", "local"])
    fit = lambda n, *by: F.sum(n).over(Window.partitionBy("doc_id", "__context", *by)) == 1
    pairs = pairs.withColumn("__p", fit("mails", "first", "last")).withColumn("__m", fit("people", "local")).where("__p and __m")
    material = F.concat(F.col("__context").cast("binary"), F.lit(b"\0"), F.array_join("p.tokens", " ").cast("binary"))
    keyed = pairs.select(F.explode(F.array("p.person", "address")).alias("k"), F.concat(F.lit("identity-"), hmac_sha256(secret, material)).alias("identity_key"))
    keyed = keyed.select("k.*", "identity_key").dropDuplicates(KEYS)
    return entities.join(keyed, KEYS, "left").withColumn("link_scope", F.when(F.col("identity_key").isNotNull(), "identity"))
