"""JSON found inside free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.functions.text import col

# Fixed patterns: a fenced block, the shortest object or list, the longest object.
FENCED = r"(?s)```(?:json)?\s*(\{.*?\}|\[.*?\])\s*```"
FENCED_OBJECT = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
SHORTEST = r"(?s)(\{.*?\}|\[.*?\])"
LONGEST_OBJECT = r"(?s)(\{.*\})"


def json_candidate(c: Column | str) -> Column:
    """Fenced JSON, else the shortest brace or bracket span, else the text itself."""
    return F.coalesce(
        F.nullif(F.regexp_extract(col(c), FENCED, 1), F.lit("")),
        F.nullif(F.regexp_extract(col(c), SHORTEST, 1), F.lit("")),
        col(c),
    )


def json_kind(v: Column) -> Column:
    """object, array, scalar, or text when there is no parsed value."""
    shape = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), F.lit("text"))
        .when(shape.startswith("OBJECT"), F.lit("object"))
        .when(shape.startswith("ARRAY"), F.lit("array"))
        .otherwise(F.lit("scalar"))
    )


def extract_json(c: Column | str) -> Column:
    """Struct (kind, value, raw): raw is the candidate, or the whole text when it does not parse."""
    candidate = json_candidate(c)
    value = F.try_parse_json(candidate)
    return F.struct(
        json_kind(value).alias("kind"),
        value.alias("value"),
        F.when(value.isNull(), col(c)).otherwise(candidate).alias("raw"),
    )


def _object_text(c: Column) -> Column:
    parsed = F.try_parse_json(c)
    return F.when(parsed.isNotNull(), c)


def extract_json_object(c: Column | str) -> Column:
    """Text of the first parsable of: the whole, a fenced object, the outermost braces; else ``{}``."""
    return F.coalesce(
        _object_text(F.nullif(col(c), F.lit(""))),
        _object_text(F.nullif(F.regexp_extract(col(c), FENCED_OBJECT, 1), F.lit(""))),
        _object_text(F.nullif(F.regexp_extract(col(c), LONGEST_OBJECT, 1), F.lit(""))),
        F.lit("{}"),
    )


def unfence(c: Column | str) -> Column:
    """Drop the first and last line of a fenced block."""
    from trailmark.functions.text import strip

    s = strip(c)
    lines = F.split(s, "\n")
    inner = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    return F.when(s.startswith("```"), inner).otherwise(s)
