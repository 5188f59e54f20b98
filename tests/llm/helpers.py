"""Small fixtures that the tests of the corpus operators share."""

import random

from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCUMENT = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
    ]
)
ENGLISH = "the of and to in that is was for on with as his they be at one have this from or had by hot word but".split()
GERMAN = "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass".split()


def documents(spark, rows):
    """(doc_id, text[, lang]) tuples as a table of documents."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DOCUMENT)


def prose(seed, count, words=ENGLISH):
    draw = random.Random(seed)
    return " ".join(draw.choice(words) + draw.choice(["", "", "", "s", "ing", "."]) for _ in range(count))


def clashing(df, *names):
    """The table with further columns of the given names, and one that differs from ``text`` by case only."""
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit("x").alias(n) for n in names), F.lit("other").alias("TEXT"))


def edge_rows():
    return [(1, None, None), (2, "", "en"), (3, " \n\t ", "en"), (3, " \n\t ", "en"), (None, "word", None), (4, "wörter " * 30_000, "de"), (5, "0 1 2", None)]
