"""Keyed, repeatable replacements for distinct values, with retries where a fake would not do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import detectors
from ..functions.fakes import synthetic
from ..functions.values import keyed_digest, normalized_value, seed_after
from .propagate import with_value
from .store import stored

ATTEMPTS = 64
#: Types whose fakes must be found again, over their whole length, by their own detectors.
_REDETECTED = {"EMAIL": "email", "PHONE": "phone", "SSN": "ssn", "CREDIT_CARD": "card", "IP_ADDRESS": "ip"}


def digest(secret: bytes) -> Column:
    """Of an entity's row (value, identity_key, link_scope): the key under which it is replaced."""
    scope = F.coalesce("link_scope", "entity_type")
    own = F.when(F.col("identity_key").isNotNull(), F.lower(F.trim("identity_key"))).otherwise(F.col("value"))
    return keyed_digest(secret, scope, own)


def bounded_substrings(text: Column) -> Column:
    """Every substring that could stand alone between word boundaries."""
    word = lambda at: F.rlike(F.substr(text, at, F.lit(1)), F.lit("(?U)\\w"))
    places = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    starts = F.filter(places, lambda i: (i == 1) | ~word(i - 1))
    ends = F.filter(places, lambda j: (j == F.length(text)) | ~word(j + 1))
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.filter(ends, lambda j: j >= i), lambda j: F.substr(text, i, j - i + 1)))))


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that later steps read instead of repeating its expression, which would grow with each step."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _revalidated(entity_type: Column, fake: Column) -> Column:
    """A structured fake is of its type; a date is one; anything else is not blank. By construction of the fakes only their shape matters."""
    shape = {
        "EMAIL": "^[a-z0-9.+]+@example\\.com$", "PHONE": "^\\+1 202-555-0\\d{3}$", "SSN": "^[78]\\d\\d-\\d\\d-\\d{4}$",
        "CREDIT_CARD": "^\\d{4}( \\d{4}){3}$", "IP_ADDRESS": "^(192\\.0\\.2\\.\\d{1,3}|2001:db8::[0-9a-f]{1,4})$",
    }
    fits: Column = F.length(F.trim(fake)) > 0
    for name, pattern in shape.items():
        fits = F.when(entity_type == name, F.rlike(fake, F.lit(pattern))).otherwise(fits)
    return fits


def replacements(entities: DataFrame, secret: bytes, forbidden: DataFrame | None = None) -> DataFrame:
    """doc_id, entity_type, digest, replacement of each distinct value of entities (with identity_key and link_scope).

    A fake must differ from the value, must not contain any original of its type in the
    document between word boundaries (forbidden: doc_id, entity_type, value; by default
    those of entities), and must be valid. The first of ATTEMPTS seeds that gives such a
    one counts; a value for which none does has a null replacement.
    """
    if len(secret) < 16:
        raise ValueError("the secret must have 16 bytes at least")
    keyed = settled(with_value(entities), "digest", digest(secret))
    first = F.min_by(F.struct("text", "value", "version", F.col("link_scope").isNotNull().alias("linked")), F.struct("seq", "start", "end"))
    distinct = stored(keyed.groupBy("doc_id", "entity_type", "digest").agg(first.alias("o")), "values")
    originals = (forbidden if forbidden is not None else keyed).select("doc_id", "entity_type", F.col("value").alias("part")).distinct()

    def tried(rows: DataFrame, attempts: Column) -> DataFrame:
        """The first attempt that passes, for those rows of which one does."""
        each = rows.select("*", F.explode(attempts).alias("attempt"))
        each = settled(each, "seed", seed_after(F.substring("digest", 1, 16), F.col("attempt")))
        each = settled(each, "fake", synthetic(F.col("entity_type"), F.col("seed"), F.col("o.text"), F.col("o.version"), F.col("o.linked")))
        each = settled(each, "plain", normalized_value(F.col("entity_type"), F.col("fake"))).where(_revalidated(F.col("entity_type"), F.col("fake")) & (F.col("plain") != F.col("o.value")))
        hits = each.select("doc_id", "entity_type", "digest", "attempt", F.explode(bounded_substrings(F.col("plain"))).alias("part")).join(originals, ["doc_id", "entity_type", "part"], "left_semi")
        passed = each.join(hits, ["doc_id", "entity_type", "digest", "attempt"], "left_anti")
        return passed.groupBy("doc_id", "entity_type", "digest").agg(F.min_by("fake", "attempt").alias("replacement"))

    keys = ["doc_id", "entity_type", "digest"]
    at_once = stored(tried(distinct, F.array(F.lit(0))), "fakes")
    later = tried(distinct.join(at_once, keys, "left_anti"), F.sequence(F.lit(1), F.lit(ATTEMPTS - 1)))
    return distinct.select(*keys).join(at_once.unionByName(later), keys, "left")


def revalidate(entity_type: str, fake: str) -> bool:
    """The detectors' own verdict on a fake; what the column form relies on is tested against it."""
    import datetime as dt

    if entity_type == "DOB":
        return detectors.birth_date(fake, dt.date.today()) is not None
    if entity_type not in _REDETECTED:
        return bool(fake.strip())
    return any(c.start == 0 and c.end == len(fake) for c in detectors.scan(fake, [], dt.date.today(), (_REDETECTED[entity_type],)))
