"""Name, slug and sentence normal forms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.schemas import LEGAL_SUFFIXES

# fixed value: the year pattern
YEAR = r"\b(1[0-9]{3}|20[0-9]{2})\b"


def normalize_name(name: Column) -> Column:
    """Whitespace runs (Unicode) become one space; ends trimmed."""
    return F.trim(F.regexp_replace(name, r"(?U)\s+", " "))


def relation_slug(name: Column) -> Column:
    """``country of citizenship`` -> ``COUNTRY_OF_CITIZENSHIP``; empty or digit-led slugs get ``REL_``."""
    slug = F.upper(F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(slug.rlike("^([0-9]|$)"), F.concat(F.lit("REL_"), slug)).otherwise(slug)


def readable_relation(name: Column) -> Column:
    return F.translate(F.lower(F.trim(name)), " -/", "___")


def normal_sentence(text: Column) -> Column:
    """Tokenised and natural spellings of a sentence compare equal in this form."""
    glued = F.regexp_replace(text, r"\s+([,.'\)\]:;!?%])", "$1")
    return F.lower(F.trim(F.regexp_replace(glued, r"\s+", " ")))


def value_key(value: Column) -> Column:
    """Year when the value holds one, else the value: ``1991`` and ``May 1991`` share a key."""
    year = F.regexp_extract(value, YEAR, 1)
    return F.when(year != "", F.concat(F.lit("year:"), year)).otherwise(F.concat(F.lit("raw:"), value))


def strip_legal_suffix(name: Column) -> Column:
    """Name without its legal suffix; null when there is none."""
    pattern = r"\s+(?:" + "|".join(LEGAL_SUFFIXES) + ")$"
    return F.when(name.rlike(pattern), F.trim(F.regexp_replace(name, pattern, "")))


def global_entity_id(name: Column, kind: Column) -> Column:
    return F.concat_ws("::", name, kind)


def vertex_index(entity_id: Column) -> Column:
    """``E12`` -> 12."""
    return F.regexp_replace(entity_id, "^E+", "").cast("int")


def is_revised(split: Column) -> Column:
    return F.endswith(split, F.lit("_revised"))


def joined(array: Column, sep: str = ",") -> Column:
    """Array rendered as text for flat sinks."""
    return F.array_join(array.cast("array<string>"), sep)
