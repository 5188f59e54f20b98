from pyspark.sql import Column, functions as F


def col(name: str, alias: str | None = None) -> Column:
    """A column by its exact name, also when it holds dots, spaces or a reserved word."""
    prefix = f"`{alias}`." if alias else ""
    return F.col(prefix + "`" + name.replace("`", "``") + "`")
