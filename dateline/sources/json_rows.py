"""JSON text to rows, with a verdict on the whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def with_parsed(texts: DataFrame, text: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """Add the fields of ``schema`` plus ``_corrupt_record``, null for a good text.

    The fields leave a generator, so a filter on them does not parse the text again,
    and all of it is read: whether a text counts as malformed does not depend on the
    columns a query uses.
    """
    marked = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "FAILFAST" if strict else "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    row = F.from_json(text, marked, options)
    return texts.select("*", F.inline_outer(F.array(row)))
