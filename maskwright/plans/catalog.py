"""Registered queries of the engine and their DuckDB counterparts.

Queries over documents and pages run over whole tables. Types that the supplied tables
don't hold are exercised over texts that both sides derive from the star schema.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detectors, fakes, ner, values
from ..functions.types import NER, containers_of
from ..operators import detect, plan, propagate, pseudonymize, report, rewrite, score
from ..operators.link import link
from ..operators.store import stored

SECRET = b"an-example-secret-0123456789"
TODAY = dt.date(2026, 1, 1)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers_of(_table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers_of(_table(spark, sf_dir, "pages"), F.col("page_id"), F.col("html"))


def _found(containers: DataFrame, *names: str) -> DataFrame:
    return detect.detect(containers, names, TODAY)


# Detection over the supplied texts ---------------------------------------------------


def _counted(entities: DataFrame, value: Column) -> DataFrame:
    return entities.select(F.col("doc_id").cast("bigint").alias("doc_id"), value.alias("value")).groupBy("doc_id", "value").agg(F.count("*").alias("n"))


def detect_email(spark, sf_dir):
    return _counted(_found(_documents(spark, sf_dir), "email"), F.col("normalized"))


def detect_pages_email(spark, sf_dir):
    return _counted(_found(_pages(spark, sf_dir), "email"), F.col("normalized"))


def detect_card(spark, sf_dir):
    return _counted(_found(_documents(spark, sf_dir), "card"), F.col("normalized"))


def detect_ipv4(spark, sf_dir):
    return _counted(_found(_documents(spark, sf_dir), "ip"), F.col("normalized"))


def detect_phone(spark, sf_dir):
    return _counted(_found(_documents(spark, sf_dir), "phone"), F.concat_ws("|", "text", F.col("confidence").cast("string")))


_EDGE = "[^\\p{L}\\p{N}_.]"
_SQL_EMAIL = """
select {key} as doc_id, lower(v) as value, count(*) as n from (
    select {key}, unnest(regexp_extract_all({text}, '(?:^|[^\\p{{L}}\\p{{N}}_.!#$%&''*+/=?^`{{|}}~-])([A-Za-z0-9!#$%&''*+/=?^_`{{|}}~-]+(?:\\.[A-Za-z0-9!#$%&''*+/=?^_`{{|}}~-]+)*@[A-Za-z0-9](?:[A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?(?:\\.[A-Za-z0-9](?:[A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?)+)(?:$|[^\\p{{L}}\\p{{N}}_@-])', 1)) as v
    from {table} where contains({text}, '@'))
where length(v) <= 254 and position('@' in v) <= 65 group by all
"""
# RE2 cannot look around: other characters are doubled, so that one of each pair can serve as the edge of either neighbour.
_SQL_CARD = """
with c as (select doc_id, regexp_replace(v, '[^0-9]', '', 'g') as value from (
    select doc_id, unnest(regexp_extract_all(regexp_replace(text, '([^0-9])', '\\1\\1', 'g'), '(?:^|[^0-9])((?:[0-9](?:  |--)?){12,18}[0-9])(?:$|[^0-9])', 1)) as v from documents))
select doc_id, value, count(*) as n from c where (
    select sum(case when (length(value) - k) % 2 = 1 then case when 2 * d > 9 then 2 * d - 9 else 2 * d end else d end)
    from (select k, cast(substr(value, k::int, 1) as int) as d from unnest(range(1, length(value) + 1)) as r(k))) % 10 = 0 group by all
"""
_SQL_IP = f"""
select doc_id, value, count(*) as n from (
    select doc_id, unnest(regexp_extract_all(text, '(?:^|{_EDGE})((?:[0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}})(?:$|{_EDGE})', 1)) as value from documents)
where list_bool_and(list_transform(string_split(value, '.'), lambda x: cast(x as int) <= 255 and (x = '0' or x[1] <> '0'))) group by all
"""
_SQL_PHONE = f"""
with c as (select doc_id, v, regexp_replace(v, '[^0-9]', '', 'g') as d, substr(text, greatest(1, position(v in text) - 60), least(60, position(v in text) - 1)) as before from (
    select doc_id, text, unnest(regexp_extract_all(text, '(?:^|{_EDGE})((?:\\+\\s*)?(?:\\([0-9]{{2,4}}\\)|[0-9])(?:[\\s().-]*[0-9]){{7,14}})(?:$|{_EDGE})', 1)) as v from documents)),
s as (select *, case when v[1] = '+' then case when length(d) >= 9 and list_unique(string_split(d, '')) >= 3 then '0.98' end
    when length(d) = 10 and d[1] in ('6', '7', '8', '9') then '0.94'
    when d[1] = '0' and length(d) in (10, 11) and length(regexp_replace(v, '[^ ().-]', '', 'g')) >= 2 then '0.95' end as confidence from c)
select doc_id, v || '|' || confidence as value, count(*) as n from s where confidence is not null and length(d) between 8 and 15
    and not regexp_matches(before, '(?i)\\b(?:CIN|DIN|ISIN|SEBI|registration|reference|folio|application|invoice|order|ticket|offer|shares?|amount|million|crore|lakh|page|financial\\s+year)\\b[^\\n]{{0,36}}$')
    and not regexp_matches(before, '(?:₹|\\$|€|£)\\s*[0-9,.\\s]*$') group by all
"""


# Detection over derived texts --------------------------------------------------------


def _derived(spark, sf_dir, table: str, key: str, text: str, spans: str | None = None) -> DataFrame:
    df = _table(spark, sf_dir, table)
    return containers_of(df, F.col(key), F.expr(text), ner=F.expr(spans).cast(NER) if spans else None)


def _of_key(entities: DataFrame, *columns: Column) -> DataFrame:
    return entities.select(F.col("doc_id").cast("bigint").alias("key"), *columns)


def detect_ssn_derived(spark, sf_dir):
    text = "concat('SSN: ', lpad(c_custkey % 1000, 3, '0'), '-', lpad(c_custkey % 100, 2, '0'), '-', lpad(c_custkey % 9999, 4, '0'), ' on file')"
    return _of_key(_found(_derived(spark, sf_dir, "customer", "c_custkey", text), "ssn"), F.col("text").alias("value"), F.col("start"))


_SQL_SSN = """
select c_custkey as key, v as value, 5 as start from (select c_custkey, lpad((c_custkey % 1000)::varchar, 3, '0') || '-' || lpad((c_custkey % 100)::varchar, 2, '0') || '-' || lpad((c_custkey % 9999)::varchar, 4, '0') as v from customer)
where c_custkey % 1000 not in (0, 666) and c_custkey % 1000 < 900 and c_custkey % 100 <> 0 and c_custkey % 9999 <> 0 and v not in ('078-05-1120', '219-09-9999')
"""


def detect_dob_derived(spark, sf_dir):
    text = "case when o_orderkey % 3 = 0 then concat('DOB: ', date_format(o_orderdate, 'dd/MM/yyyy')) when o_orderkey % 3 = 1 then concat('born on ', date_format(o_orderdate, 'd MMMM yyyy'), '.') else concat('dated ', date_format(o_orderdate, 'yyyy-MM-dd')) end"
    found = _found(_derived(spark, sf_dir, "orders", "o_orderkey", text), "dob")
    return _of_key(found, F.col("normalized").alias("iso"), F.col("start"), F.col("end"))


_SQL_DOB = """
select o_orderkey as key, strftime(o_orderdate, '%Y-%m-%d') as iso, s as start, s + length(v) as "end" from (
    select *, case when o_orderkey % 3 = 0 then 5 else 8 end as s, case when o_orderkey % 3 = 0 then strftime(o_orderdate, '%d/%m/%Y') else strftime(o_orderdate, '%-d %B %Y') end as v from orders)
where o_orderkey % 3 < 2
"""


def detect_company_legal_derived(spark, sf_dir):
    text = "concat('Registrar to the Offer: ', initcap(translate(cast(s_suppkey % 1000 as string), '0123456789', 'abcdefghij')), ' Works Private Limited, also ', case when s_suppkey % 2 = 0 then 'Family Trust Limited' else 'Formerly Delta Ltd.' end)"
    found = _found(_derived(spark, sf_dir, "supplier", "s_suppkey", text), "company")
    return _of_key(found, F.col("text").alias("value"), F.col("confidence"))


_SQL_COMPANY = """
with w as (select s_suppkey, translate((s_suppkey % 1000)::varchar, '0123456789', 'abcdefghij') as w from supplier), n as (select s_suppkey, upper(w[1]) || w[2:] as name from w)
select s_suppkey as key, name || ' Works Private Limited' as value, 0.97 as confidence from n
union all select s_suppkey, 'Delta Ltd.', 0.97 from n where s_suppkey % 2 = 1
"""


def detect_address_derived(spark, sf_dir):
    text = "concat('Registered Office: Flat ', c_custkey % 90 + 1, ', ', case when c_custkey % 2 = 0 then 'Hill Road' else 'Green' end, ', Pune 4110', lpad(c_custkey % 100, 2, '0'), ', India. Tel: none')"
    found = _found(_derived(spark, sf_dir, "customer", "c_custkey", text), "address")
    return _of_key(found, F.col("text").alias("value"), F.round("confidence", 4).alias("confidence"))


_SQL_ADDRESS = """
select c_custkey as key, 'Flat ' || (c_custkey % 90 + 1) || ', ' || case when c_custkey % 2 = 0 then 'Hill Road' else 'Green' end || ', Pune 4110' || lpad((c_custkey % 100)::varchar, 2, '0') || ', India' as value, 0.99::double as confidence from customer
"""

_LETTERS = "translate(cast(c_custkey % 1000 as string), '0123456789', 'abcdefghij')"


def detect_person_role_derived(spark, sf_dir):
    text = f"concat('Contact Persons: Mr Ann ', initcap({_LETTERS}), ' / Bob Stone (Director); Hill Road and Zed')"
    return _of_key(_found(_derived(spark, sf_dir, "customer", "c_custkey", text), "person"), F.col("text").alias("value"), F.col("start"), F.col("confidence"))


_SQL_PERSON = """
with n as (select c_custkey, translate((c_custkey % 1000)::varchar, '0123456789', 'abcdefghij') as w from customer)
select c_custkey as key, 'Ann ' || upper(w[1]) || w[2:] as value, 20 as start, 0.96::double as confidence from n
union all select c_custkey, 'Bob Stone', 27 + length(w), 0.96 from n
"""


def detect_company_ner_derived(spark, sf_dir):
    text = "concat('The auditor is ', case when c_custkey % 3 = 0 then 'Orion & Vale' when c_custkey % 3 = 1 then 'Orion Vale Securities' else 'Audit Committee' end, ' since ', c_custkey % 50 + 1950)"
    spans = "array(named_struct('label', 'ORG', 'start', 15, 'end', 15 + case when c_custkey % 3 = 0 then 12 when c_custkey % 3 = 1 then 21 else 15 end))"
    return _of_key(_found(_derived(spark, sf_dir, "customer", "c_custkey", text, spans), "company"), F.col("text").alias("value"), F.round("confidence", 4).alias("confidence"))


_SQL_COMPANY_NER = """
select c_custkey as key, case when c_custkey % 3 = 0 then 'Orion & Vale' else 'Orion Vale Securities' end as value, case when c_custkey % 3 = 0 then 0.88 else 0.94 end::double as confidence from customer where c_custkey % 3 < 2
"""


def detect_person_ner_derived(spark, sf_dir):
    """Names from a gazetteer; the second is qualified by the role before it."""
    text = f"concat('Spoke with Ann Lee about ', {_LETTERS}, '. CEO: Bob Stone')"
    containers = _derived(spark, sf_dir, "customer", "c_custkey", text)
    containers = ner.with_ner(containers, ner.gazetteer(F.col("text"), {"PERSON": ["Ann Lee", "Bob Stone", "Bob"], "ORG": ["Hill Road"]}))
    return _of_key(_found(containers, "person"), F.col("text").alias("value"), F.col("start"), F.round("confidence", 4).alias("confidence"))


_SQL_PERSON_NER = """
select c_custkey as key, 'Ann Lee' as value, 11 as start, 0.84::double as confidence from customer
union all select c_custkey, 'Bob Stone', 32 + length((c_custkey % 1000)::varchar), 0.98 from customer
"""


# Conflicts and propagation -----------------------------------------------------------

_CANDIDATES = """
select cast(l_orderkey as string) as doc_id, 'body/p0000' as container_id, 0 as seq, 'BODY_PARAGRAPH' as story_type,
    element_at(array('EMAIL', 'PHONE', 'CREDIT_CARD', 'PERSON', 'COMPANY', 'ADDRESS', 'DOB'), cast(l_partkey % 7 as int) + 1) as entity_type,
    cast(l_suppkey % 40 as int) as start, cast(l_suppkey % 40 + 3 + l_partkey % 12 as int) as end, 'x' as text,
    cast(80 + l_quantity % 20 as double) / 100 as confidence, concat('r', l_linenumber) as recognizer, cast(null as string) as normalized,
    l_partkey % 2 = 0 as validated, l_partkey % 3 = 0 as strong_context, cast(array() as array<string>) as signals, cast(null as int) as version, cast(null as string) as ner_label
from lineitem
"""


def _candidates(spark, sf_dir) -> DataFrame:
    _table(spark, sf_dir, "lineitem").createOrReplaceTempView("__maskwright_lineitem")
    return spark.sql(_CANDIDATES.replace("from lineitem", "from __maskwright_lineitem"))


def resolve_conflicts(spark, sf_dir):
    fields = ["entity_type", "start", "end", "text", "confidence", "recognizer", "normalized", "validated", "strong_context", "signals", "version", "ner_label"]
    grouped = _candidates(spark, sf_dir).groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias("found"))
    kept = grouped.select(F.col("doc_id").cast("bigint").alias("key"), F.explode(detect.resolved(F.col("found"))).alias("e"))
    return kept.select("key", "e.entity_type", "e.start", "e.end", F.round("e.confidence", 4).alias("confidence"), "e.recognizer")


_SQL_CANDIDATES = """
c as (select l_orderkey as key, ['EMAIL', 'PHONE', 'CREDIT_CARD', 'PERSON', 'COMPANY', 'ADDRESS', 'DOB'][(l_partkey % 7)::int + 1] as entity_type, [80, 70, 90, 40, 30, 50, 60][(l_partkey % 7)::int + 1] as priority,
    (l_suppkey % 40)::int as s, (l_suppkey % 40 + 3 + l_partkey % 12)::int as e, (80 + l_quantity % 20)::double / 100 as confidence, 'r' || l_linenumber as recognizer, l_partkey % 2 = 0 as validated, l_partkey % 3 = 0 as strong from lineitem),
t as (select *, case when l.entity_type in ('EMAIL', 'PHONE', 'CREDIT_CARD') and validated then 3 when strong then 2 else 1 end as tier from c l)
"""
_SQL_RESOLVE = f"""
with recursive {_SQL_CANDIDATES},
o as (select *, row_number() over (partition by key order by -tier, -confidence, s - e, -priority, s, e, recognizer, entity_type) as k from t),
step as (
    select key, k, [{{'s': s, 'e': e}}] as kept, true as chosen from o where k = 1
    union all
    select o.key, o.k, case when ok then list_append(kept, {{'s': o.s, 'e': o.e}}) else kept end, ok
    from (select o.*, p.kept, len(list_filter(p.kept, lambda x: x.s < o.e and o.s < x.e)) = 0 as ok from step p join o on o.key = p.key and o.k = p.k + 1) as o
)
select o.key, entity_type, s as start, e as "end", round(confidence, 4) as confidence, recognizer from o join step using (key, k) where chosen
"""


def resolve_tier(spark, sf_dir):
    tiers = _candidates(spark, sf_dir).select(detect.tier(F.struct("entity_type", "validated", "strong_context")).alias("tier"), "entity_type")
    return tiers.groupBy("tier", "entity_type").agg(F.count("*").alias("n"))


def overlap_conflicts(spark, sf_dir):
    spans = _candidates(spark, sf_dir).dropDuplicates(["doc_id", "start", "end", "entity_type"])
    found = plan.overlap_conflicts(spans)
    return found.select(F.col("doc_id").cast("bigint").alias("key"), F.get("entity_types", F.lit(0)).alias("first_type"), F.get("entity_types", F.lit(1)).alias("second_type"), F.get("spans", F.lit(0))["end"].alias("first_end"), F.get("spans", F.lit(1))["start"].alias("second_start"))


_SQL_OVERLAP = f"""
with {_SQL_CANDIDATES}, d as (select distinct key, s, e, entity_type from t),
w as (select *, lag(e) over p as pe, lag(entity_type) over p as pt from d window p as (partition by key order by s, e, entity_type))
select key, pt as first_type, entity_type as second_type, pe as first_end, s as second_start from w where s < pe
"""


def propagate_repeats(spark, sf_dir):
    text = "concat('Dear ', 'Ann ', initcap(" + _LETTERS + "), ', ann  ', " + _LETTERS + ", ' wrote; xAnn ', " + _LETTERS + ", '. CEO: Ann ', initcap(" + _LETTERS + "))"
    containers = _derived(spark, sf_dir, "customer", "c_custkey", text)
    found = stored(_found(containers, "person"), "people")
    out = propagate.propagate(containers, found).where(F.col("recognizer") == propagate.REPEAT)
    return _of_key(out, F.col("text").alias("value"), F.col("start"))


_SQL_REPEATS = """
with n as (select c_custkey, translate((c_custkey % 1000)::varchar, '0123456789', 'abcdefghij') as w from customer)
select c_custkey as key, 'Ann ' || upper(w[1]) || w[2:] as value, 5 as start from n union all select c_custkey, 'ann  ' || w, 11 + length(w) from n
"""


# Values and fakes --------------------------------------------------------------------


def normalize_values(spark, sf_dir):
    df = _table(spark, sf_dir, "customer")
    variants = F.array(
        F.struct(F.lit("PHONE").alias("t"), F.expr("concat('+1 (', lpad(c_custkey % 1000, 3, '0'), ') ', c_nationkey, '-555')").alias("v")),
        F.struct(F.lit("EMAIL").alias("t"), F.expr("concat(' ', upper(replace(c_name, '#', '.')), '@Example.com ')").alias("v")),
        F.struct(F.lit("PERSON").alias("t"), F.expr("concat(c_name, '  \\t', upper(c_mktsegment))").alias("v")),
        F.struct(F.lit("IP_ADDRESS").alias("t"), F.expr("concat('10.0.0.', c_custkey % 256)").alias("v")),
    )
    each = df.select(F.col("c_custkey").alias("key"), F.explode(variants).alias("x"))
    return each.select("key", F.col("x.t").alias("entity_type"), values.normalized_value(F.col("x.t"), F.col("x.v")).alias("value"))


_SQL_NORMALIZE = """
select c_custkey as key, 'PHONE' as entity_type, '1' || lpad((c_custkey % 1000)::varchar, 3, '0') || c_nationkey || '555' as value from customer
union all select c_custkey, 'EMAIL', lower(replace(c_name, '#', '.')) || '@example.com' from customer
union all select c_custkey, 'PERSON', lower(c_name) || ' ' || lower(c_mktsegment) from customer
union all select c_custkey, 'IP_ADDRESS', '10.0.0.' || c_custkey % 256 from customer
"""


def _seeds(spark, sf_dir) -> DataFrame:
    df = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lower("c_name").alias("value"))
    return df.select("*", F.explode(F.array(F.substring(values.keyed_digest(SECRET, F.lit("PERSON"), F.col("value")), 1, 16))).alias("seed"))


def _pad(byte: int) -> str:
    return "".join(f"\\x{b ^ byte:02X}" for b in SECRET.ljust(64, b"\0"))


_SQL_SEEDS = f"""
h as (select c_custkey as key, sha256('{_pad(0x5C)}'::blob || unhex(sha256('{_pad(0x36)}'::blob || encode('PERSON') || '\\x00'::blob || encode(lower(c_name))))) as hex from customer),
s as (select key, hex, ('0x' || substr(hex, 1, 16))::ubigint as seed from h)
"""


def hmac_seed(spark, sf_dir):
    later = values.seed_after(F.col("seed"), F.lit(5))
    return _seeds(spark, sf_dir).select("key", "seed", values.seed_number(F.col("seed")).cast("string").alias("number"), later.alias("sixth_seed"))


_SQL_HMAC = f"""with {_SQL_SEEDS} select key, substr(hex, 1, 16) as seed, seed::varchar as number,
    lower(lpad(to_hex(((seed::hugeint + 5 * {values.STRIDE}::hugeint) % {values.MODULUS}::hugeint)::ubigint), 16, '0')) as sixth_seed from s"""


def _fake(name: str):
    def query(spark, sf_dir):
        seed = F.col("seed")
        made = {
            "person": fakes.person(seed), "email": fakes.email(seed, F.col("key") % 2 == 0), "phone": fakes.phone(seed), "company": fakes.company(seed), "address": fakes.address(seed), "ssn": fakes.ssn(seed),
            "card": fakes.card(seed), "dob": fakes.birth_date(seed, F.when(F.col("key") % 2 == 0, "1/2/1990").otherwise("1990-02-01")), "ipv4": fakes.ip(seed, F.lit(4)), "ipv6": fakes.ip(seed, F.lit(6)),
        }
        return _seeds(spark, sf_dir).select("key", made[name].alias("value"))

    return query


def _sql_list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_SQL_LAST = f"{_sql_list(fakes.LAST_NAMES)}[((seed >> 8) % 16)::int + 1]"
_SQL_FIRST = f"{_sql_list(fakes.FIRST_NAMES)}[(seed % 16)::int + 1]"
_SQL_LUHN = "(10 - list_sum(list_transform(range(1, 16), lambda k: case when k % 2 = 1 then case when 2 * d[k]::int > 9 then 2 * d[k]::int - 9 else 2 * d[k]::int end else d[k]::int end)) % 10) % 10"
_SQL_FAKES = {
    "person": f"{_SQL_FIRST} || ' ' || chr((65 + (seed >> 16) % 26)::int) || '. ' || {_SQL_LAST}",
    "email": f"case when key % 2 = 0 then lower({_SQL_FIRST}) || '.' || lower({_SQL_LAST}) else 'synthetic.contact+' || substr(hex, 11, 6) end || '@example.com'",
    "phone": "'+1 202-555-' || lpad((100 + seed % 100)::varchar, 4, '0')",
    "company": f"'Example ' || {_sql_list(fakes.COMPANY_WORDS)}[(seed % 8)::int + 1] || ' ' || {_sql_list(fakes.COMPANY_INDUSTRIES)}[((seed >> 8) % 8)::int + 1] || ' ' || upper(substr(hex, 9, 4)) || ' Private Limited'",
    "address": "'Unit ' || (100 + seed % 900) || ', Example Heights ' || (1 + (seed >> 10) % 20) || ', Synthetic Avenue, Pune – ' || (411900 + (seed >> 16) % 100) || ', Maharashtra, India'",
    "ssn": "(700 + seed % 199) || '-' || lpad((1 + (seed >> 8) % 99)::varchar, 2, '0') || '-' || lpad((1 + (seed >> 16) % 9999)::varchar, 4, '0')",
    "dob": "case when key % 2 = 0 then strftime(date '1970-01-01' + (seed % 10950)::int, '%d/%m/%Y') else strftime(date '1970-01-01' + (seed % 10950)::int, '%Y-%m-%d') end",
    "ipv4": "'192.0.2.' || (1 + seed % 254)",
    "ipv6": "'2001:db8::' || lower(to_hex(1 + seed % 65534))",
}
_SQL_CARD_FAKE = f"""with {_SQL_SEEDS}, p as (select key, '424242' || lpad((seed % 1000000000)::varchar, 9, '0') as d from s), f as (select key, d || {_SQL_LUHN} as c from p)
select key, substr(c, 1, 4) || ' ' || substr(c, 5, 4) || ' ' || substr(c, 9, 4) || ' ' || substr(c, 13, 4) as value from f"""


def mask_values(spark, sf_dir):
    df = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name", "c_mktsegment")
    kinds = F.array(*[F.struct(F.lit(t).alias("t"), F.expr(v).alias("v")) for t, v in (("EMAIL", "concat(c_name, '@mail.example.com')"), ("PHONE", "concat('+1 555 ', key)"), ("PERSON", "concat(c_name, ', ', c_mktsegment)"), ("SSN", "'123-45-6789'"))])
    each = df.select("key", F.explode(kinds).alias("x"))
    return each.select("key", F.col("x.t").alias("entity_type"), values.masked(F.col("x.t"), F.col("x.v")).alias("masked"))


_SQL_WORDS = "list_aggregate(list_transform(regexp_extract_all({0}, '[A-Za-z0-9]+|[^A-Za-z0-9]+'), lambda w: case when regexp_matches(w, '^[A-Za-z0-9]+$') then w[1] || repeat('•', least(greatest(length(w) - 1, 2), 7)) else w end), 'string_agg', '')"
_SQL_MASK = f"""
select c_custkey as key, 'EMAIL' as entity_type, substr(c_name, 1, 2) || '•••@ma•••.com' as masked from customer
union all select c_custkey, 'PHONE', '+••••••••' || right('1555' || c_custkey, 2) from customer
union all select c_custkey, 'SSN', '•••-••-89' from customer
union all select c_custkey, 'PERSON', {_SQL_WORDS.format("c_name || ', ' || c_mktsegment")} from customer
"""


def link_person_email(spark, sf_dir):
    """Names of nations' first customers against addresses, each nation a container; unique pairs from either side."""
    df = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("doc_id"), F.lit("body/p0000").alias("container_id"), F.col("c_custkey").alias("start"), F.expr(_LETTERS).alias("w"))
    people = df.select("*", F.lit("PERSON").alias("entity_type"), F.concat(F.lit("Ann "), F.initcap("w")).alias("text"))
    mails = df.where("start % 2 = 0").select("*", F.lit("EMAIL").alias("entity_type"), F.concat(F.when(F.col("start") % 4 == 0, "a").otherwise("ann."), F.col("w"), F.lit("@x.org")).alias("text"))
    linked = link(people.union(mails).withColumn("end", F.col("start") + F.length("text")), SECRET).where("link_scope = 'identity'")
    side = lambda kind, name: linked.where(F.col("entity_type") == kind).select("doc_id", "identity_key", F.col("start").alias(name))
    return side("PERSON", "person").join(side("EMAIL", "mail_key"), ["doc_id", "identity_key"]).select("person", "mail_key")


_SQL_LINK = """
with d as (select c_custkey, c_nationkey, translate((c_custkey % 1000)::varchar, '0123456789', 'abcdefghij') as w from customer),
p as (select c_nationkey, c_custkey as person, w from d),
m as (select c_nationkey, c_custkey as mail_key, case when c_custkey % 4 = 0 then 'a' else 'ann' end || w as local from d where c_custkey % 2 = 0),
j as (select c_nationkey, person, mail_key from p join m using (c_nationkey) where (contains(local, 'ann') and contains(local, w)) or starts_with(local, 'a' || w)),
k as (select *, count(*) over (partition by c_nationkey, person) as np, count(*) over (partition by c_nationkey, mail_key) as nm from j)
select person, mail_key from k where np = 1 and nm = 1
"""


def consistency_check(spark, sf_dir):
    """Values whose later replacement differs from their first."""
    replacement = (F.col("l_partkey") % 50 > 0).cast("string")
    named = _table(spark, sf_dir, "lineitem").select(F.lit("d").alias("doc_id"), F.lit("PERSON").alias("entity_type"), F.col("l_suppkey").alias("value"), replacement.alias("replacement"), F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("start"), F.col("l_linenumber").alias("end"))
    return plan.with_odd(named).groupBy("value").agg(F.count_if("odd").alias("n")).where("n > 0")


_SQL_CONSISTENCY = """
select value, count(*) filter (odd) as n from (select l_suppkey as value, (l_partkey % 50 > 0) <> first_value(l_partkey % 50 > 0) over (partition by l_suppkey order by l_orderkey, l_linenumber) as odd from lineitem) group by value having count(*) filter (odd) > 0
"""


# Rewriting ---------------------------------------------------------------------------


def run_offsets(spark, sf_dir):
    runs = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.split("p_name", " ").alias("runs"))
    each = runs.select("key", F.explode(rewrite.run_starts(F.col("runs"))).alias("r"))
    return each.select("key", "r.run_index", "r.start", "r.end")


_SQL_RUNS = """
r as (select p_partkey as key, unnest(string_split(p_name, ' ')) as run, generate_subscripts(string_split(p_name, ' '), 1) - 1 as run_index from part),
f as (select key, run, run_index::int as run_index, (sum(length(run)) over (partition by key order by run_index) - length(run))::int as start, (sum(length(run)) over (partition by key order by run_index))::int as "end" from r)
"""


def affected_runs(spark, sf_dir):
    runs = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.split("p_name", " ").alias("runs"))
    return runs.select("key", rewrite.affected_runs(F.col("runs"), F.lit(1), (F.col("key") % 9 + 2).cast("int")).alias("n"))


def rewrite_runs(spark, sf_dir):
    runs = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.split("p_name", " ").alias("runs"))
    change = F.array(F.struct(F.lit(1).alias("start"), (F.col("key") % 5 + 2).cast("int").alias("end"), F.lit("NEW").alias("replacement")))
    return runs.select("key", F.array_join(rewrite.rewritten_runs(F.col("runs"), change), "|").alias("runs"))


_SQL_REWRITE_RUNS = f"""
with {_SQL_RUNS}, x as (select *, (key % 5 + 2)::int as t from f)
select key, string_agg(case when start < t and 1 < "end" then substr(run, 1, greatest(1 - start, 0)) || case when start <= 1 then 'NEW' else '' end || substr(run, least(t, "end") - start + 1) else run end, '|' order by run_index) as runs from x group by key
"""


def rewrite_documents(spark, sf_dir):
    """Each document with its first fifth and last three characters replaced, as a length and a digest; texts too short for both change in one place."""
    df = _table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    n = F.length("text")
    spans = F.array(F.struct(F.lit(0).alias("start"), F.floor(n / 5).cast("int").alias("end"), F.lit("«A»").alias("replacement")), F.struct((n - 3).alias("start"), n.alias("end"), F.lit("Z").alias("replacement")))
    last = F.array(F.struct(F.lit(0).alias("start"), n.alias("end"), F.lit("Z").alias("replacement")))
    new = rewrite.rewritten_text(F.col("text"), F.when(n >= 10, spans).otherwise(last))
    return df.select("doc_id", F.length(new).alias("n"), F.sha2(new, 256).alias("digest"))


_SQL_REWRITE = "select doc_id, length(v)::int as n, sha256(v) as digest from (select doc_id, '«A»' || substr(text, floor(length(text) / 5)::int + 1, length(text) - 3 - floor(length(text) / 5)::int) || 'Z' as v from documents where length(text) >= 10 union all select doc_id, 'Z' from documents where coalesce(length(text), 0) < 10)"


def preflight_unsafe(spark, sf_dir):
    df = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.split("p_name", " ").alias("runs"))
    change = F.array(F.struct(F.lit(1).alias("start"), (F.col("key") % 5 + 2).cast("int").alias("end"), F.lit("NEW").alias("replacement")))
    changed = rewrite.changed_runs(F.col("runs"), rewrite.rewritten_runs(F.col("runs"), change))
    return df.select("key", rewrite.unsafe(F.col("key") % 7 != 0, F.array((F.col("key") % 3).cast("int")), changed).alias("unsafe"))


_SQL_PREFLIGHT = f"""
with {_SQL_RUNS}, x as (select *, (key % 5 + 2)::int as t from f), c as (select key, bool_or(start < t and 1 < "end" and run_index = key % 3) as hit from x group by key)
select key, key % 7 = 0 or hit as unsafe from c
"""


def synthetic_spans(spark, sf_dir):
    one = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"))
    df = one.select(
        F.col("l_orderkey").alias("doc_id"), F.lit("c").alias("container_id"), (F.col("l_linenumber") * 30).cast("int").alias("start"), (F.col("l_linenumber") * 30 + 5).cast("int").alias("end"),
        F.repeat(F.lit("x"), (F.col("l_partkey") % 20 + 1).cast("int")).alias("replacement"),
    )
    return plan.synthetic_spans(df).select("doc_id", "start", "end")


_SQL_SPANS = """
select doc_id, (s + m)::int as start, (s + m + n)::int as "end" from (select l_orderkey as doc_id, l_linenumber * 30 as s, l_partkey % 20 + 1 as n, coalesce(sum(l_partkey % 20 + 1 - 5) over (partition by l_orderkey order by l_linenumber rows between unbounded preceding and 1 preceding), 0) as m from (select l_orderkey, l_linenumber, max(l_partkey) as l_partkey from lineitem group by 1, 2))
"""


# Planning and verification over documents --------------------------------------------


def _plan(spark, sf_dir):
    containers = _documents(spark, sf_dir)
    return containers, plan.build_plan(containers, SECRET, today=TODAY)


def detections_by_type(spark, sf_dir):
    return report.detections_by_type(_found(_documents(spark, sf_dir), *detectors.NAMES))


def plan_by_type(spark, sf_dir):
    _, made = _plan(spark, sf_dir)
    return made.replacements.groupBy("entity_type", "recognizer").agg(F.count("*").alias("n"), F.count_distinct("replacement").alias("replacements"))


def leak_classify(spark, sf_dir):
    containers, made = _plan(spark, sf_dir)
    again = _found(plan.rewritten(containers, made.replacements), *detectors.NAMES)
    return plan.residuals(again, made.replacements).groupBy("classification", "entity_type").agg(F.count("*").alias("n"))


# Notes: one address of mail in each, and an IP address in every third, which the plan leaves alone.


def _notes(spark, sf_dir, six: bool = False):
    ip = "concat('2001:0db8:0000:0000:0000:0000:0000:', lpad(lower(hex(c_custkey % 65000 + 1)), 4, '0'))" if six else "concat('10.1.2.', c_custkey % 250 + 1)"
    text = f"concat('Write to a', {_LETTERS}, '@mail', c_nationkey, '.org', case when c_custkey % 3 = 0 then concat(' from ', {ip}) else '' end)"
    found = containers_of(_table(spark, sf_dir, "customer"), F.col("c_custkey"), F.expr(text))
    story = F.element_at(F.array(*map(F.lit, ("BODY_PARAGRAPH", "TABLE_CELL_PARAGRAPH", "HEADER_PARAGRAPH"))), (F.col("doc_id").cast("int") % 3 + 1))
    return found.withColumn("story_type", story)


def _notes_plan(spark, sf_dir):
    notes = _notes(spark, sf_dir)
    return notes, plan.build_plan(notes, SECRET, ("email",), TODAY)


def _listed(spark, counts: dict):
    """metric, value of a report's counts; by type as metric.TYPE."""
    rows = [(k, str(v)) for k, v in counts.items() if not isinstance(v, dict)] + [(f"{k}.{t}", str(n)) for k, v in counts.items() if isinstance(v, dict) for t, n in v.items() if n]
    return spark.createDataFrame(rows, "metric string, value string")


def plan_summary(spark, sf_dir):
    return _listed(spark, report.plan_summary(_notes_plan(spark, sf_dir)[1]))


def _leaks(spark, sf_dir):
    notes, made = _notes_plan(spark, sf_dir)
    return report.leak_summary(plan.residuals(_found(plan.applied(notes, made), "email", "ip"), made.replacements))


def leak_summary(spark, sf_dir):
    return _listed(spark, _leaks(spark, sf_dir))


def quality_gate(spark, sf_dir):
    """The gate over a table that still holds IP addresses, and over one whose scan is clear."""
    clear = report.leak_summary(plan.plain_residuals(_found(_notes(spark, sf_dir), "ssn")))
    return spark.createDataFrame([("left", report.quality_gate(_leaks(spark, sf_dir))), ("clear", report.quality_gate(clear)), ("links", report.quality_gate(clear, 1))], "scan string, gate string")


def replacements_by_story(spark, sf_dir):
    return report.replacements_by_story(_notes_plan(spark, sf_dir)[1].replacements)


def plain_residuals(spark, sf_dir):
    return plan.plain_residuals(_found(_notes(spark, sf_dir), "email", "ip")).groupBy("classification", "entity_type").agg(F.count("*").alias("n"))


def stale_plan(spark, sf_dir):
    """Replacements whose text has changed since they were planned: every fifth note."""
    notes, made = _notes_plan(spark, sf_dir)
    changed = notes.withColumn("text", F.when(F.col("doc_id").cast("int") % 5 == 0, F.concat(F.lit("Re: "), "text")).otherwise(F.col("text")))
    return detect.invalid_spans(changed, made.replacements).select(F.col("doc_id").cast("bigint").alias("key"), "start")


def detect_ipv6_derived(spark, sf_dir):
    return _counted(_found(_notes(spark, sf_dir, six=True), "ip"), F.col("normalized"))


_NOTES = "n as (select c_custkey, c_custkey % 3 = 0 as ip from customer)"
_SQL_PLAN_SUMMARY = f"""with {_NOTES}, c as (select count(*)::varchar as n from n)
select unnest(['planned_replacement_count', 'planned_replacements_by_type.EMAIL', 'exact_repeat_propagation_count', 'cross_run_replacement_count', 'text_box_replacement_count', 'mirrored_representation_update_count', 'linked_identity_count', 'linked_entity_count', 'conflict_count', 'quality_gate']) as metric,
    unnest([n, n, '0', '0', '0', '0', '0', '0', '0', 'CONFLICT_FREE_PLAN']) as value from c"""
_SQL_LEAK_SUMMARY = f"""with {_NOTES}, c as (select count(*) as m, count(*) filter (ip) as i from n)
select unnest(['high_confidence_detection_count', 'known_synthetic_detection_count', 'exact_known_synthetic_detection_count', 'synthetic_contained_detection_count', 'broad_overlap_review_count', 'unclassified_residual_count', 'review_required_count', 'detections_by_type.EMAIL', 'detections_by_type.IP_ADDRESS', 'review_required_by_type.IP_ADDRESS', 'unclassified_by_type.IP_ADDRESS']) as metric,
    unnest([m + i, m, m, 0, 0, i, i, m, i, i, i])::varchar as value from c"""
_SQL_GATE = "select unnest(['left', 'clear', 'links']) as scan, unnest(['WRITE_COMPLETED_WITH_RESIDUAL_REVIEW', 'WRITE_COMPLETED_SUPPORTED_TEXT_SCAN_CLEAR', 'WRITE_COMPLETED_WITH_RESIDUAL_REVIEW']) as gate"
_SQL_BY_STORY = "select ['BODY_PARAGRAPH', 'TABLE_CELL_PARAGRAPH', 'HEADER_PARAGRAPH'][(c_custkey % 3)::int + 1] as story_type, count(*) as replacements from customer group by 1"
_SQL_PLAIN = "select 'UNCLASSIFIED' as classification, 'EMAIL' as entity_type, count(*) as n from customer union all select 'UNCLASSIFIED', 'IP_ADDRESS', count(*) from customer where c_custkey % 3 = 0"
_SQL_STALE = "select c_custkey as key, 9::int as start from customer where c_custkey % 5 = 0"
_SQL_IPV6 = "select c_custkey as doc_id, '2001:db8::' || lower(to_hex(c_custkey % 65000 + 1)) as value, 1::bigint as n from customer where c_custkey % 3 = 0"


def forbidden_retry(spark, sf_dir):
    """Names whose fakes must not hold one of four names that the document has: later seeds are tried."""
    none = F.lit(None).cast("string")
    entities = _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("doc_id"), F.lit("PERSON").alias("entity_type"), F.col("c_name").alias("text"), none.alias("normalized"), F.lit(None).cast("int").alias("version"),
        none.alias("identity_key"), none.alias("link_scope"), F.lit(0).alias("seq"), F.lit(0).alias("start"), F.length("c_name").alias("end"),
    )
    originals = entities.select("doc_id", "entity_type", F.explode(F.array(*[F.lit(n.lower()) for n in fakes.FIRST_NAMES[:4]])).alias("value"))
    return pseudonymize.replacements(entities, SECRET, originals).select(F.col("doc_id").cast("bigint").alias("key"), "replacement")


_SQL_FORBIDDEN = f"""
with {_SQL_SEEDS}, t as (select key, hex, a.k as k, ((seed::hugeint + a.k * {values.STRIDE}::hugeint) % {values.MODULUS}::hugeint)::ubigint as seed from s, (select unnest(range(0, 40)) as k) a),
f as (select key, k, {_SQL_FAKES["person"]} as value from t)
select key, arg_min(value, k) as replacement from f where not list_contains({_sql_list(fakes.FIRST_NAMES[:4])}, split_part(value, ' ', 1)) group by key
"""


def repeat_flag(spark, sf_dir):
    found = report.with_repeats(_found(_documents(spark, sf_dir), "card"))
    return found.select(F.col("doc_id").cast("bigint").alias("doc_id"), "value", "occurrences", "repeated").distinct()


_SQL_REPEAT_FLAG = f"select doc_id, value, n as occurrences, n > 1 as repeated from ({_SQL_CARD})"


def preview_limit(spark, sf_dir):
    return report.preview(_found(_documents(spark, sf_dir), "ip"), ["IP_ADDRESS"], 100)


def top_types(spark, sf_dir):
    """Each type as found alone: a card's number that runs on into an address of a network doesn't take it from the count."""
    docs = _documents(spark, sf_dir)
    return report.top_types(_found(docs, "ip").unionByName(_found(docs, "card")))


_SQL_TOP = f"select 'CREDIT_CARD' as entity_type, sum(n)::bigint as accepted from ({_SQL_CARD}) having sum(n) > 0 union all select 'IP_ADDRESS', sum(n)::bigint from ({_SQL_IP}) having sum(n) > 0"


def _stories(df: DataFrame) -> DataFrame:
    story = F.element_at(F.array(*map(F.lit, ("BODY_PARAGRAPH", "TABLE_CELL_PARAGRAPH", "HEADER_PARAGRAPH"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return df.select(story.alias("story_type"))


def containers_by_story(spark, sf_dir):
    return report.containers_by_story(_stories(_table(spark, sf_dir, "part"))).select("story_type", "containers")


_SQL_STORY = "select s.story_type, count(p_partkey) as containers from (values (0, 'BODY_PARAGRAPH'), (1, 'TABLE_CELL_PARAGRAPH'), (2, 'HEADER_PARAGRAPH'), (3, 'FOOTER_PARAGRAPH'), (4, 'TEXT_BOX_PARAGRAPH')) s(k, story_type) left join part on p_partkey % 3 = s.k group by 1"


def context_key(spark, sf_dir):
    path = F.expr("concat('body/t0001/r', lpad(l_linenumber, 4, '0'), case when l_orderkey % 2 = 0 then '/c0000/p0001' when l_orderkey % 4 = 1 then '/c0002/t0000/r0007/c0001/p0000' else '' end)")
    return _table(spark, sf_dir, "lineitem").select(values.context_key(path).alias("context")).groupBy("context").agg(F.count("*").alias("n"))


_SQL_CONTEXT = "select 'body/t0001/r' || lpad(l_linenumber::varchar, 4, '0') || case when l_orderkey % 4 = 1 then '/c0002/t0000/r0007' else '' end as context, count(*) as n from lineitem group by 1"


# Scoring -----------------------------------------------------------------------------


def _labelled(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    df = _table(spark, sf_dir, "lineitem")
    kind = F.element_at(F.array(*map(F.lit, ("EMAIL", "PHONE", "ADDRESS", "PERSON"))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    place = (F.col("l_linenumber") * 20).cast("int")
    truth = df.where("l_partkey % 10 < 8").select(F.col("l_orderkey").alias("container_id"), kind.alias("entity_type"), place.alias("start"), (place + 10).alias("end"))
    shift = F.when(F.col("l_partkey") % 6 == 0, 3).otherwise(0)
    made = df.where("l_partkey % 10 > 1").select(F.col("l_orderkey").alias("container_id"), kind.alias("entity_type"), (place + shift).alias("start"), (place + 10 + shift).alias("end"))
    return made, truth


_SQL_LABELLED = """
b as (select l_orderkey as c, ['EMAIL', 'PHONE', 'ADDRESS', 'PERSON'][(l_suppkey % 4)::int + 1] as t, l_linenumber * 20 as s, case when l_partkey % 6 = 0 then 3 else 0 end as d, l_partkey % 10 as m from lineitem),
truth as (select distinct c, t, s, s + 10 as e from b where m < 8), made as (select distinct c, t, s + d as s, s + 10 + d as e from b where m > 1),
o as (select coalesce(p.t, g.t) as t, case when p.c is not null and g.c is not null then 'tp' when p.c is not null then 'fp' else 'fn' end as k from made p full join truth g on p.c = g.c and p.t = g.t and p.s = g.s and p.e = g.e),
n as (select t, count(*) filter (k = 'tp') as tp, count(*) filter (k = 'fp') as fp, count(*) filter (k = 'fn') as fn from o group by t)
"""
_RATIOS = "round(coalesce(tp / nullif(tp + fp, 0), 0), 9) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) as f1, round(tp / nullif(tp + fp + fn, 0), 9) as accuracy"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


def exact_counts_by_type(spark, sf_dir):
    return _rounded(score.exact_by_type(*_labelled(spark, sf_dir)), "entity_type", "tp", "fp", "fn")


_SQL_EXACT = f"""with {_SQL_LABELLED}, e as (select x.t as entity_type, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, coalesce(fn, 0) as fn from (select unnest(['PERSON', 'EMAIL', 'PHONE', 'COMPANY', 'ADDRESS', 'SSN', 'CREDIT_CARD', 'DOB', 'IP_ADDRESS']) as t) x left join n using (t))
select entity_type, tp, fp, fn, {_RATIOS} from e"""


def micro_metrics(spark, sf_dir):
    return _rounded(score.micro(*_labelled(spark, sf_dir)), "tp", "fp", "fn")


_SQL_MICRO = f"with {_SQL_LABELLED}, e as (select sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from n) select tp, fp, fn, {_RATIOS} from e"


def macro_metrics(spark, sf_dir):
    return _rounded(score.macro(*_labelled(spark, sf_dir)), "included_types")


_SQL_MACRO = f"with {_SQL_LABELLED}, e as (select tp / nullif(tp + fp, 0) as p, tp / nullif(tp + fn, 0) as r, 2 * tp / nullif(2 * tp + fp + fn, 0) as f, tp / nullif(tp + fp + fn, 0) as a from n where t in (select t from truth)) select count(*) as included_types, round(avg(coalesce(p, 0)), 9) as precision, round(avg(coalesce(r, 0)), 9) as recall, round(avg(coalesce(f, 0)), 9) as f1, round(avg(a), 9) as accuracy from e"


def error_distribution(spark, sf_dir):
    return score.errors_by_type(*_labelled(spark, sf_dir))


_SQL_ERRORS = f"with {_SQL_LABELLED} select k as kind, t as entity_type, count(*) as n from o where k <> 'tp' group by 1, 2"


def relaxed_address(spark, sf_dir):
    return score.relaxed(*_labelled(spark, sf_dir)).select("tp", "fp", "fn")


# Lines of one container are 20 apart, so that a span has partners on its own line only, where the truth has one span.
_SQL_RELAXED = f"""with {_SQL_LABELLED}, q as (select count(distinct (g.c, g.s)) as tp from made p join truth g on p.c = g.c and p.t = 'ADDRESS' and g.t = 'ADDRESS' and 2 * (least(p.e, g.e) - greatest(p.s, g.s)) >= 10)
select tp, (select count(*) from made where t = 'ADDRESS') - tp as fp, (select count(*) from truth where t = 'ADDRESS') - tp as fn from q"""


_PLAIN = (
    detect_email, detect_pages_email, detect_card, detect_ipv4, detect_phone, detect_ssn_derived, detect_dob_derived, detect_company_legal_derived, detect_address_derived, detect_person_role_derived,
    detect_company_ner_derived, detect_person_ner_derived, resolve_conflicts, resolve_tier, overlap_conflicts, propagate_repeats, normalize_values, hmac_seed, mask_values, link_person_email, consistency_check, run_offsets, affected_runs,
    rewrite_runs, rewrite_documents, preflight_unsafe, synthetic_spans, detections_by_type, plan_by_type, leak_classify, repeat_flag, preview_limit, top_types, containers_by_story, context_key,
    exact_counts_by_type, micro_metrics, macro_metrics, error_distribution, relaxed_address, plan_summary, leak_summary, quality_gate, replacements_by_story, plain_residuals, stale_plan, detect_ipv6_derived, forbidden_retry,
)


def queries() -> dict:
    return {f.__name__: f for f in _PLAIN} | {f"fake_{name}": _fake(name) for name in [*_SQL_FAKES, "card"]}


def oracle_sql() -> dict[str, str]:
    return {
        "detect_email": _SQL_EMAIL.format(key="doc_id", text="text", table="documents"), "detect_pages_email": _SQL_EMAIL.format(key="page_id", text="html", table="pages"),
        "detect_card": _SQL_CARD, "detect_ipv4": _SQL_IP, "detect_phone": _SQL_PHONE, "detect_ssn_derived": _SQL_SSN, "detect_dob_derived": _SQL_DOB, "detect_company_legal_derived": _SQL_COMPANY,
        "detect_address_derived": _SQL_ADDRESS, "detect_person_role_derived": _SQL_PERSON, "detect_company_ner_derived": _SQL_COMPANY_NER, "detect_person_ner_derived": _SQL_PERSON_NER, "resolve_conflicts": _SQL_RESOLVE,
        "resolve_tier": f"with {_SQL_CANDIDATES} select tier, entity_type, count(*) as n from t group by 1, 2", "overlap_conflicts": _SQL_OVERLAP, "propagate_repeats": _SQL_REPEATS,
        "normalize_values": _SQL_NORMALIZE, "hmac_seed": _SQL_HMAC, "mask_values": _SQL_MASK, "link_person_email": _SQL_LINK, "consistency_check": _SQL_CONSISTENCY,
        "run_offsets": f'with {_SQL_RUNS} select key, run_index, start, "end" from f',
        "affected_runs": f'with {_SQL_RUNS} select key, count(*) filter (start < key % 9 + 2 and 1 < "end" and start < "end")::int as n from f group by key',
        "rewrite_runs": _SQL_REWRITE_RUNS, "rewrite_documents": _SQL_REWRITE, "preflight_unsafe": _SQL_PREFLIGHT, "synthetic_spans": _SQL_SPANS, "repeat_flag": _SQL_REPEAT_FLAG, "top_types": _SQL_TOP,
        "containers_by_story": _SQL_STORY, "context_key": _SQL_CONTEXT, "exact_counts_by_type": _SQL_EXACT, "micro_metrics": _SQL_MICRO, "macro_metrics": _SQL_MACRO,
        "plan_summary": _SQL_PLAN_SUMMARY, "leak_summary": _SQL_LEAK_SUMMARY, "quality_gate": _SQL_GATE, "replacements_by_story": _SQL_BY_STORY, "plain_residuals": _SQL_PLAIN, "stale_plan": _SQL_STALE,
        "detect_ipv6_derived": _SQL_IPV6, "forbidden_retry": _SQL_FORBIDDEN, "error_distribution": _SQL_ERRORS, "relaxed_address": _SQL_RELAXED, "fake_card": _SQL_CARD_FAKE,
        **{f"fake_{name}": f"with {_SQL_SEEDS} select key, {sql} as value from s" for name, sql in _SQL_FAKES.items()},
    }
