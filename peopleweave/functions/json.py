"""Functions over JSON text."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, trim_ws

# A string literal and, for an object's key, the colon after it. Possessive, so that long strings need no stack.
_LITERAL = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"(\s*+:)?+'


def nested_strings(value) -> Column:
    """All strings at any depth of a JSON text, in its order, trimmed and without empty ones; keys are no values.

    In valid JSON a literal that a colon follows is a key and any other one is a value, so one pass over the text replaces a walk of unknown depth.
    Null and invalid texts give an empty array.
    """
    text = col(value)
    found = F.zip_with(F.regexp_extract_all(text, F.lit(_LITERAL), F.lit(1)), F.regexp_extract_all(text, F.lit(_LITERAL), F.lit(2)),
                       lambda s, colon: F.when(colon == "", s))
    plain = F.transform(F.filter(found, lambda s: s.isNotNull()), lambda s: trim_ws(
        F.when(s.contains("\\"), F.from_json(F.concat(F.lit('["'), s, F.lit('"]')), "array<string>")[0]).otherwise(s)))
    none = F.array().cast("array<string>")
    return F.when(F.try_parse_json(text).isNull(), none).otherwise(F.filter(plain, lambda s: s != ""))
