"""Text tokens that mean NULL in a delimited file."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The tokens that count as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def na_to_null(column: Column) -> Column:
    return F.when(~column.isin(*NA_TOKENS), column)
