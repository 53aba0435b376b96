"""JSON out of model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strophe.functions.text import strip


def json_text(c: Column) -> Column:
    """The fenced block if there is one, trimmed to its outermost brackets."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?(.*?)(?:```|\z)", 1)
    inside = F.when(c.contains("```"), fenced).otherwise(c)
    return F.regexp_replace(F.regexp_replace(inside, r"^[^{\[]*", ""), r"[^}\]]*\z", "")


def without_trailing_commas(c: Column) -> Column:
    """N02."""
    return F.regexp_replace(c, r",(\s*[}\]])", "$1")


def repaired(c: Column) -> Column:
    """Strict JSON from lenient: trailing commas go, single quotes become double where no double is used."""
    loose = without_trailing_commas(json_text(c))
    return F.when(loose.contains('"'), loose).otherwise(F.replace(loose, F.lit("'"), F.lit('"')))


def parsed(c: Column, schema: str) -> Column:
    """Strict parse, then the repaired text; null if neither parses."""
    strict = F.from_json(json_text(c), schema)
    return F.coalesce(F.when(F.try_parse_json(json_text(c)).isNotNull(), strict), F.when(F.try_parse_json(repaired(c)).isNotNull(), F.from_json(repaired(c), schema)))


def songs(c: Column, item: str = "description string, lyrics string") -> Column:
    """A JSON list, or one object, as an array of structs."""
    t = strip(without_trailing_commas(json_text(c)))
    return F.when(t.startswith("["), F.from_json(t, f"array<struct<{item}>>")).otherwise(F.array(F.from_json(t, f"struct<{item}>")))


def get(m: Column, key: str, default) -> Column:
    """A map's value or the default."""
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))


def tracks(response: Column) -> Column:
    """The track list of a service's answer, wherever it stands."""
    v = F.try_parse_json(response)
    t = "array<struct<id:string,audioUrl:string,title:string,duration:double>>"
    paths = ("$.data", "$.sunoData", "$.response.sunoData", "$.tracks", "$.items")
    return F.coalesce(*(F.try_variant_get(v, p, t) for p in paths))
