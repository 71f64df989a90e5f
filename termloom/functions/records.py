"""Maps, JSON and requests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold_accents

# Attribute names as they come, without accents and signs, and as they are kept.
ATTRIBUTE_NAMES = {
    "familyrelationship": "familyRelationship", "familyrelation": "familyRelationship", "relative": "familyRelationship", "sitio": "site", "sitioanatomico": "site",
    "laterality": "laterality", "lateralidad": "laterality", "valor": "value", "value": "value", "result": "result", "resultado": "result", "stage": "stage", "estadio": "stage",
    "via": "route", "route": "route", "dose": "dose", "dosis": "dose", "frequency": "frequency", "frecuencia": "frequency", "relativetime": "relativeTime", "tiempo": "relativeTime",
    "momento": "relativeTime", "condition": "condition", "condicion": "condition", "plannedaction": "plannedAction",
}


def attribute_name(name: Column) -> Column:
    """The kept name of an attribute; others stay as they are. Names of ASCII letters and digits need no pattern."""
    folded = F.lower(F.regexp_replace(fold_accents(name), "[^A-Za-z0-9]", ""))
    known = F.create_map(*(F.lit(x) for pair in ATTRIBUTE_NAMES.items() for x in pair))
    return F.coalesce(known[F.lower(name)], F.when(name.rlike("[^A-Za-z0-9]"), known[folded]), name)


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _chosen(entries: Column, beaten) -> Column:
    """Entries (key, value) that beaten(all, entry, place) doesn't hold for; all, where keys differ."""
    kept = lambda x: F.filter(x, lambda e, i: ~beaten(x, e, i))
    keys = lambda x: F.transform(x, lambda e: e["key"])
    return let(entries, lambda x: F.when(F.size(F.array_distinct(keys(x))) == F.size(x), x).otherwise(kept(x)))


def last_of_each(entries: Column) -> Column:
    """Entries (key, value) without those that a later one of the same key replaces."""
    return _chosen(entries, lambda x, e, i: F.exists(F.slice(x, i + 2, F.size(x)), lambda y: y["key"] == e["key"]))


def first_of_each(entries: Column) -> Column:
    """Entries (key, value) whose key no earlier one has."""
    return _chosen(entries, lambda x, e, i: (i > 0) & F.exists(F.slice(x, 1, F.greatest(i, F.lit(1))), lambda y: y["key"] == e["key"]))


def attributes(raw: Column) -> Column:
    """A map of attributes under their kept names; of several with one name the last."""
    none = F.create_map().cast("map<string,string>")
    renamed = F.transform(F.map_entries(F.coalesce(raw, none)), lambda e: F.struct(attribute_name(e["key"]).alias("key"), e["value"].alias("value")))
    return F.map_from_entries(last_of_each(renamed))


def is_preferred(acceptability: Column, preferred_id: str) -> Column:
    """Whether any refset in a description's acceptability map prefers it."""
    return F.coalesce(F.array_contains(F.map_values(acceptability), preferred_id), F.lit(False))


def refset_ids(acceptability: Column) -> Column:
    return F.array_sort(F.coalesce(F.map_keys(acceptability), F.array().cast("array<string>")))


def loose_json(text: Column) -> Column:
    """The JSON object in a text, as compact JSON: that of the first fence, if there is one, from
    its first brace to its last; null if it doesn't parse."""
    fence = "(?is)```(?:json)?\\s*(.*?)```"
    inner = F.when(text.rlike(fence), F.regexp_extract(text, fence, 1)).otherwise(text)
    return F.to_json(F.try_parse_json(F.regexp_extract(inner, "(?s)[{].*[}]", 0)))


def equality_key(*parts: Column) -> Column:
    """One string that is equal exactly where all parts are, nulls among themselves included. Parts
    of one place have one type."""
    return F.to_json(F.array(*(p.cast("string") for p in parts)))


VALUE_KINDS = ("valueUri", "valueCode", "valueString", "valueBoolean")


def request_map(parameters: Column) -> Column:
    """name to value of a Parameters resource's array of structs; of several with one name the last."""
    value = lambda p: F.coalesce(*(p[k].cast("string") for k in VALUE_KINDS))
    return F.map_from_entries(last_of_each(F.transform(parameters, lambda p: F.struct(p["name"].alias("key"), value(p).alias("value")))))


def date_reference(latest: Column, now: Column) -> Column:
    """Two days after the latest synthetic encounter; without any, now."""
    return F.coalesce(latest + F.make_dt_interval(F.lit(2)), now)
