"""Column functions on values: normal forms, keyed digests, masks, intervals. All native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The increment between attempts, and the modulus of seeds.
STRIDE, MODULUS = 0x9E3779B97F4A7C15, 1 << 64


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)\\D", "")


def folded(text: Column) -> Column:
    """Lower case as for comparison; the sharp s as two."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def collapsed(text: Column) -> Column:
    return folded(F.trim(F.regexp_replace(text, "(?U)\\s+", " ")))


_DATES = ("d/M/yyyy", "d-M-yyyy", "yyyy-M-d", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMM d yyyy")


def parsed_date(text: Column) -> Column:
    """ISO form of a date in any of the accepted shapes, null if none fits."""
    clean = F.initcap(F.trim(F.regexp_replace(text, "(?U)\\s+", " ")))
    return F.date_format(F.coalesce(*[F.try_to_timestamp(clean, F.lit(f)) for f in _DATES]), "yyyy-MM-dd")


def normalized_value(entity_type: Column, text: Column, detected: Column | None = None) -> Column:
    """The form in which equal values are equal. detected: the detector's own normal form, used for dates and addresses of networks."""
    own = detected if detected is not None else F.lit(None).cast("string")
    return (
        F.when(entity_type.isin("PHONE", "CREDIT_CARD", "SSN"), digits(text))
        .when(entity_type == "IP_ADDRESS", F.coalesce(own, folded(F.trim(text))))
        .when(entity_type == "DOB", F.coalesce(own, parsed_date(text), collapsed(text)))
        .when(entity_type == "EMAIL", folded(F.trim(text)))
        .otherwise(collapsed(text))
    )


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """Lower-case hex of HMAC-SHA256. The padded keys become literals of the plan: treat plans as secret."""
    import hashlib

    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))), 256)


def keyed_digest(secret: bytes, scope: Column, value: Column) -> Column:
    return hmac_sha256(secret, F.concat(scope.cast("binary"), F.lit(b"\0"), value.cast("binary")))


def seed_number(seed: Column) -> Column:
    """The seed, 16 hex digits, as an exact number."""
    return F.conv(seed, 16, 10).cast("decimal(20,0)")


def seed_after(seed: Column, attempt: Column) -> Column:
    """The seed of a later attempt, as 16 hex digits."""
    moved = (F.conv(seed, 16, 10).cast("decimal(38,0)") + attempt.cast("decimal(5,0)") * F.lit(str(STRIDE)).cast("decimal(20,0)")) % F.lit(str(MODULUS)).cast("decimal(20,0)")
    return F.lower(F.lpad(F.conv(moved.cast("decimal(20,0)").cast("string"), 10, 16), 16, "0"))


def seed_mod(seed: Column, modulus: int, shift: int = 0) -> Column:
    """(seed >> shift) % modulus as bigint, for shifts of whole hex digits and moduli up to 10 ** 9."""
    kept = 16 - shift // 4
    high = F.conv(F.substring(seed, 1, max(1, kept - 8)), 16, 10).cast("bigint") if kept > 8 else F.lit(0).cast("bigint")
    low = F.conv(F.substring(seed, max(1, kept - 7), min(8, kept)), 16, 10).cast("bigint")
    return ((high % modulus) * ((1 << 32) % modulus) + low % modulus) % modulus


def masked(entity_type: Column, text: Column) -> Column:
    """A form for display that keeps little of the value."""
    dots = "•••"
    at = F.locate("@", text)
    local = F.substr(text, F.lit(1), at - 1)
    domain = F.substr(text, at + 1)
    suffix = F.when(F.contains(domain, F.lit(".")), F.concat(F.lit("."), F.substring_index(domain, ".", -1))).otherwise("")
    name = F.substr(domain, F.lit(1), F.length(domain) - F.length(suffix))
    email = F.concat(F.substring(local, 1, 2), F.lit(dots + "@"), F.substring(name, 1, 2), F.lit(dots), suffix)
    words = F.split(F.regexp_replace(text, "([A-Za-z0-9]+)", "\u0001$1\u0001"), "\u0001", -1)
    word = lambda w: F.concat(F.substring(w, 1, 1), F.repeat(F.lit("•"), F.least(F.greatest(F.length(w) - 1, F.lit(2)), F.lit(7))))
    other = F.array_join(F.transform(words, lambda w: F.when(F.rlike(w, F.lit("^[A-Za-z0-9]+$")), word(w)).otherwise(w)), "")
    return (
        F.when((entity_type == "EMAIL") & (at > 0), email)
        .when(entity_type == "PHONE", F.concat(F.when(F.startswith(F.trim(text), F.lit("+")), "+").otherwise(""), F.lit("•" * 8), F.right(digits(text), F.lit(2))))
        .when(entity_type == "SSN", F.concat(F.lit("•••-••-"), F.right(digits(text), F.lit(2))))
        .when(entity_type == "CREDIT_CARD", F.concat(F.lit("•••• •••• •••• "), F.right(digits(text), F.lit(4))))
        .when(entity_type == "DOB", F.lit("•• •••• ••••"))
        .when(entity_type == "IP_ADDRESS", F.when(F.contains(text, F.lit(".")), "•••.•••.•••.•••").otherwise("••••:••••:…"))
        .otherwise(other)
    )


def shown_signals(signals: Column) -> Column:
    """The first three, in words."""
    words = F.array_join(F.transform(F.slice(signals, 1, 3), lambda s: F.lower(F.replace(s, F.lit("_"), F.lit(" ")))), ", ")
    return F.coalesce(F.nullif(words, F.lit("")), F.lit("context-qualified"))


def context_key(container_id: Column) -> Column:
    """The innermost table row that holds the container, or the container itself."""
    return F.coalesce(F.nullif(F.regexp_extract(container_id, "^(.+/r\\d{4})/c\\d{4}/", 1), F.lit("")), container_id)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def overlap_ratio(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """The intersection's share of the shorter span."""
    shared = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    return shared / F.least(a_end - a_start, b_end - b_start)


def url_unquoted(text: Column) -> Column:
    """Percent-decoding that leaves plus signs alone."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
