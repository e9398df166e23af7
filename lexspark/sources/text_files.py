"""Sources of the engine's types: delimited text with vector and array literals, and token text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions.types import TSVECTOR, parse_tsvector


def vectors_from_text(text: Column) -> Column:
    """Token vectors of a column of vector literals, in Arrow batches."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(parse_tsvector, na_action="ignore")

    return F.pandas_udf(run, TSVECTOR)(text)


def arrays_from_text(text: Column, element: str = "int") -> Column:
    """Arrays of a column of array literals; nested arrays and NULL elements are errors."""
    body = F.regexp_replace(F.trim(text), r"^\{|\}$", "")
    checked = (
        F.when(F.contains(body, F.lit("{")), F.raise_error(F.lit("array must have 1 dimension")).cast("string"))
        .when(F.upper(body).rlike(r"(^|,)\s*NULL\s*(,|$)"), F.raise_error(F.lit("array must not contain nulls")).cast("string"))
        .otherwise(body)
    )
    return F.when(checked == "", F.array().cast(f"array<{element}>")).otherwise(F.split(checked, r"\s*,\s*").cast(f"array<{element}>"))


def read_delimited(spark: SparkSession, path: str, columns: str, vectors: tuple[str, ...] = (), arrays: dict[str, str] | None = None, delimiter: str = "\t") -> DataFrame:
    """Rows of delimited text (``columns``: a DDL schema), with literals of vectors and arrays parsed. ``\\N`` is null."""
    fields = F.split(F.col("value"), f"\\Q{delimiter}\\E", -1)
    out = []
    for i, c in enumerate(columns.split(",")):
        name, kind = c.split()
        text = F.nullif(F.get(fields, F.lit(i)), F.lit("\\N"))
        if name in vectors:
            out.append(vectors_from_text(text).alias(name))
        elif arrays and name in arrays:
            out.append(arrays_from_text(text, arrays[name]).alias(name))
        else:
            out.append(text.cast(kind).alias(name))
    return spark.read.text(path).select(*out)
