"""Column helpers: hashes, parsing, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.contracts import ALERT_FEATURES, COUNTRIES

# Fixed value: the name space of domain names in RFC 4122, as hex digits.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def hex_mod(digits: Column, modulus: int) -> Column:
    """A 32-digit hex number modulo ``modulus``, in four chunks that fit a long."""
    step = 2 ** 32 % modulus
    rest = F.lit(0).cast("long")
    for i in range(4):
        chunk = F.conv(F.substring(digits, 1 + 8 * i, 8), 16, 10).cast("long")
        rest = (rest * step + chunk) % modulus
    return rest


def card_proxy(entity: Column) -> Column:
    """A card number in 1 ... 100000 from the entity's MD5."""
    return hex_mod(F.md5(entity), 100000) + 1


def uuid5_dns(name: Column) -> Column:
    """Hex digits of the version-5 UUID of ``name`` in the DNS name space."""
    digest = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), F.encode(name, "utf-8")))
    variant = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    nibble = F.lower(F.hex((variant.bitwiseAND(F.lit(3)) + 8).cast("long")))
    return F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), nibble, F.substring(digest, 18, 15))


def country(entity: Column) -> Column:
    """(code, country) bucket of an entity."""
    buckets = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(n).alias("country")) for c, n in COUNTRIES])
    return F.element_at(buckets, (hex_mod(uuid5_dns(entity), len(COUNTRIES)) + 1).cast("int"))


def parse_iso(text: Column, fallback: Column) -> Column:
    """ISO-8601 text as a timestamp; text that does not parse takes the fallback (the arrival time)."""
    return F.coalesce(F.try_to_timestamp(text), fallback)


def number_or(text: Column, default: float) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(default))


def blank_to_empty(col: Column) -> Column:
    return F.coalesce(F.trim(col.cast("string")), F.lit(""))


def replace_exact(col: Column, value: str, other: str) -> Column:
    return F.when(col == value, other).otherwise(col)


def masked_card(brand: Column, number: Column, funding: Column) -> Column:
    """``brand ••••1234 funding``."""
    return F.concat(replace_exact(brand, "", "card"), F.lit(" ••••"), F.right(number, F.lit(4)), F.lit(" "), funding)


def day_index(seconds: Column) -> Column:
    return F.floor(seconds / 86400)


def percent_text(score: Column) -> Column:
    return F.concat(F.round(score * 100, 1).cast("string"), F.lit("%"))


def parse_features(json_text: Column) -> Column:
    """Stored features with zeros for what is missing."""
    parsed = F.from_json(json_text, ALERT_FEATURES)
    return F.struct(*[F.coalesce(parsed[f.name], F.lit(0)).cast(f.dataType).alias(f.name) for f in ALERT_FEATURES])


def feature_vector(features: Column) -> Column:
    return F.array(*[features[n].cast("double") for n in ALERT_FEATURES.names])
