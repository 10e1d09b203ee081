"""Columns as the texts that exports show."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def cells(df: DataFrame) -> DataFrame:
    """Every column as its exported text: doubles with two digits, booleans Yes and No, times RFC 3339, lists and structs JSON, null empty."""

    def text(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.call_function("format_number", c, F.lit("0.00"))
        elif kind == "boolean":
            c = F.when(c, "Yes").otherwise("No")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        elif kind.startswith(("array", "struct", "map")):
            c = F.to_json(c)
        return F.when(F.col(f"`{name}`").isNull(), "").otherwise(c.cast("string")).alias(name)

    return df.select(*(text(n, k) for n, k in df.dtypes))
