"""Reading JSON objects out of what an agent wrote, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCED = r"(?is)```(?:json)?\s*(.*?)```"
# A string, which stays, or a comma in front of a closing bracket.
LOOSE_COMMA = r'("(?:[^"\\]|\\.)*+")|,(?=\s*[}\]])'


def _object(text: Column) -> Column:
    """What a text holds from its first brace on, as a VARIANT, if that is a JSON object; the parser stops at its end."""
    start = F.instr(text, "{")
    rest = F.when(start > 0, F.substring(text, start, F.length(text)))
    return F.coalesce(F.try_parse_json(rest), F.try_parse_json(F.regexp_replace(rest, LOOSE_COMMA, "$1")))


def extract_json(reply: Column) -> Column:
    """The JSON object in a reply as JSON text: of fenced blocks first, commas too many forgiven; NULL if there is none."""
    places = F.array_append(F.regexp_extract_all(reply, F.lit(FENCED), F.lit(1)), reply)
    found = F.array_compact(F.transform(places, lambda p: F.to_json(_object(p))))
    return F.try_element_at(found, F.lit(1))


def widest_object(reply: Column) -> Column:
    """What stands from the first brace to the last one, as a VARIANT; NULL if that is no JSON."""
    return F.try_parse_json(F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit("")))
