"""Vectors as short codes: one codebook for each part of the dimensions, learned with dictionaries of values.

Components become integers, and few different ones occur in a dimension. Vectors are staged in blocks
that hold, for each dimension, the dictionary of its integers and the place in it of every vector's
component. To measure a block against a codebook, the squared differences of every dictionary value to all
entries are tabulated; a part's distances are rows of these tables, gathered by place and added. Sums of
the parts that chose an entry come from the same dictionaries: counts by entry and place, times the values.

Tasks hold one block at a time and hand on sums, one set for each task; the driver holds the codebooks,
which are as large as ``ENTRIES`` vectors. Every pass reads the staged blocks, so a lost executor costs its tasks.

Defined results: a vector is dropped if it is null, empty, holds a null or a component that is not
finite, or one beyond ``LARGEST`` after scaling (its squares would leave the range of long); if its
length is not that of the kept vector with the smallest id it is dropped as well. A length that ``parts``
does not divide is filled up with zeros. Null ids come last where ids are ordered; rows that repeat an
id are coded each, and of equal ids the smaller vector seeds first; fewer kept rows than entries give as many
entries as rows; distances that tie go to the lower index, null labels are one label; a table without kept rows
gives none; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from martloom.llm.rows import pick, ready
from martloom.operators.joins import deal, hot_keys, join_parent
from martloom.session import stage

# Components of a block, and vectors at most; places in a dictionary fit 16 bits.
BLOCK_VALUES, BLOCK_ROWS = 1 << 19, 1 << 13
# Scaled components up to this size keep all squares and sums of a vector within long.
LARGEST = 1 << 24

SUMS = "part int, entry int, pos int, total long, n long"


@dataclass(frozen=True)
class Settings:
    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256


@dataclass(frozen=True)
class Coding:
    """Codebooks of (parts, entries, width) integers, and the length of the vectors they are for."""

    books: np.ndarray
    length: int

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def usable(embeddings: DataFrame, settings: Settings) -> DataFrame:
    """(vec_id, label, vector) of the rows that can be coded, whatever their length."""
    table = pick(embeddings, "vec_id", "label", "embedding").withColumn("embedding", F.col("embedding").cast("array<double>"))
    limit = LARGEST / settings.scale
    fine = F.forall("embedding", lambda x: F.coalesce((x < limit) & (x >= -limit), F.lit(False)))
    return table.where((F.size("embedding") > 0) & fine).withColumnRenamed("embedding", "vector")


def whole(vectors: np.ndarray, settings: Settings) -> np.ndarray:
    """Scaled integers of vectors, filled up to a multiple of the parts."""
    numbers = np.floor(vectors * settings.scale).astype(np.int64)
    return np.pad(numbers, ((0, 0), (0, -numbers.shape[1] % settings.parts)))


def seeds(table: DataFrame, settings: Settings) -> Coding | None:
    """Codebooks from the rows with the smallest ids; None without rows."""
    first = lambda df: df.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(settings.entries).collect()
    rows = first(table)
    if not rows:
        return None
    length = len(rows[0]["vector"])
    if any(len(r["vector"]) != length for r in rows):
        rows = first(table.where(F.size("vector") == length))
    numbers = whole(np.array([r["vector"] for r in rows], dtype=np.float64), settings)
    return Coding(_cut(numbers, settings.parts), length)


def _cut(numbers: np.ndarray, parts: int) -> np.ndarray:
    """(rows, dimensions) as (parts, rows, width)."""
    return np.ascontiguousarray(numbers.reshape(len(numbers), parts, -1).transpose(1, 0, 2))


def blocks(table: DataFrame, length: int, settings: Settings) -> DataFrame:
    """Vectors of one length as staged blocks of dictionaries and places."""
    ready(table.sparkSession)
    plain = table.where(F.size("vector") == length).select("vec_id", "label", "vector")
    kinds = [plain.schema[c].dataType for c in ("vec_id", "label")]
    schema = StructType(
        [StructField(n, ArrayType(k)) for n, k in zip(("ids", "labels"), kinds)] + [StructField(n, BinaryType()) for n in ("sizes", "values", "places")]
    )
    arrow, step = to_arrow_schema(schema), max(1, min(BLOCK_ROWS, BLOCK_VALUES // length))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                vectors = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, length)
                sizes, values, places = dictionary(whole(vectors, settings))
                cells = [[part.column(0).to_pylist()], [part.column(1).to_pylist()], [sizes.tobytes()], [values.tobytes()], [places.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cells, arrow.types, strict=True)], schema=arrow)

    return stage(plain.mapInArrow(run, schema), "blocks")


def dictionary(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and values of the dictionary of each dimension, and (dimensions, rows) places in it."""
    sizes, values = np.empty(numbers.shape[1], dtype=np.int32), []
    places = np.empty(numbers.shape[::-1], dtype=np.uint16)
    for d in range(numbers.shape[1]):
        own, places[d] = np.unique(numbers[:, d], return_inverse=True)
        sizes[d] = len(own)
        values.append(own)
    return sizes, np.concatenate(values), places


@dataclass
class Block:
    """A block as its tasks read it."""

    values: list[np.ndarray]
    places: np.ndarray

    @classmethod
    def read(cls, sizes: bytes, values: bytes, places: bytes) -> Block:
        ends = np.cumsum(np.frombuffer(sizes, dtype=np.int32))
        return cls(np.split(np.frombuffer(values, dtype=np.int64), ends[:-1]), np.frombuffer(places, dtype=np.uint16).reshape(len(ends), -1))

    def nearest(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(parts, rows) entries and squared distances."""
        parts, _, width = books.shape
        chosen = np.empty((parts, self.places.shape[1]), dtype=np.int64)
        errors = np.empty_like(chosen)
        for p in range(parts):
            far = None
            for k in range(width):
                d = p * width + k
                table = (self.values[d][:, None] - books[p, :, k][None, :]) ** 2
                gathered = table[self.places[d]]
                far = gathered if far is None else np.add(far, gathered, out=far)
            chosen[p] = far.argmin(axis=1)
            errors[p] = far[np.arange(len(far)), chosen[p]]
        return chosen, errors

    def sums(self, chosen: np.ndarray, entries: int) -> np.ndarray:
        """(dimensions, entries) sums of the components of the vectors that chose an entry."""
        width = len(self.values) // len(chosen)
        out = np.empty((len(self.values), entries), dtype=np.int64)
        for d, own in enumerate(self.values):
            counts = np.bincount(chosen[d // width] * len(own) + self.places[d], minlength=entries * len(own))
            out[d] = counts.reshape(entries, len(own)) @ own
        return out


def improve(staged: DataFrame, coding: Coding) -> Coding:
    """One round: every entry becomes the floored mean of the parts that are nearest to it."""
    books = coding.books
    parts, entries, width = books.shape
    arrow = to_arrow_schema(StructType.fromDDL(SUMS))

    def run(batches):
        totals, counts = np.zeros((parts * width, entries), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for block, _ in _read(batches):
            chosen, _ = block.nearest(books)
            totals += block.sums(chosen, entries)
            counts += np.array([np.bincount(c, minlength=entries) for c in chosen])
        d, e = (x.ravel() for x in np.indices(totals.shape))
        used = counts[d // width, e] > 0
        d, e = d[used], e[used]
        columns = (d // width, e, d % width, totals[d, e], counts[d // width, e])
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    found = staged.select("sizes", "values", "places").mapInArrow(run, SUMS)
    # as many rows come back as the codebooks have components
    summed = found.groupBy("part", "entry", "pos").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    better = books.copy()
    for r in summed:
        better[r["part"], r["entry"], r["pos"]] = int(r["total"]) // r["n"]
    return Coding(better, coding.length)


def _read(batches) -> Iterator[tuple[Block, tuple]]:
    for batch in batches:
        at = {n: i for i, n in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            cell = lambda n: batch.column(at[n])[i].as_py()  # noqa: E731, B023
            others = tuple(batch.column(at[n])[i].values for n in ("ids", "labels") if n in at)
            yield Block.read(cell("sizes"), cell("values"), cell("places")), others


def encode(staged: DataFrame, coding: Coding) -> DataFrame:
    """(vec_id, label, code, error) of all vectors in staged blocks."""
    books = coding.books
    kinds = [staged.schema[c].dataType.elementType for c in ("ids", "labels")]
    schema = StructType(
        [StructField("vec_id", kinds[0]), StructField("label", kinds[1]), StructField("code", StringType()), StructField("error", LongType())]
    )
    arrow = to_arrow_schema(schema)

    def run(batches):
        for block, (ids, labels) in _read(batches):
            chosen, errors = block.nearest(books)
            columns = (ids, labels, pa.array(codes(chosen)), pa.array(errors.sum(axis=0)))
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    return staged.mapInArrow(run, schema)


def codes(chosen: np.ndarray) -> list[str]:
    """The entries of each vector as two hex digits a part (more, if there are more than 256 entries)."""
    if chosen.size and chosen.max() > 255:
        return ["".join(f"{c:04x}" for c in row) for row in chosen.T.tolist()]
    return [bytes(row).hex() for row in chosen.T.astype(np.uint8)]


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``label_error`` beside each row: the errors of all rows with its label."""
    key = F.when(F.col("label").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("label").cast("string"))).alias("label_key")
    rows = deal(stage(coded.select("*", key), "codes"))
    totals = rows.groupBy("label_key").agg(F.sum("error").alias("label_error"))
    # the sketch only decides which labels are dealt out
    hot = hot_keys(rows, [["label_key"]]).get(("label_key",), {})
    joined = join_parent(rows, totals, ["label_key"], ["label_key"], "left", hot, "own")
    return joined.select(*(F.col(f"child.{c}") for c in coded.columns), F.col("own.label_error"))


def compress(embeddings: DataFrame, settings: Settings | None = None) -> tuple[DataFrame, Coding | None]:
    """Codes and errors of all vectors that can be coded, and the codebooks that decode them."""
    settings = settings or Settings()
    table = usable(embeddings, settings)
    coding = seeds(table, settings)
    if coding is None:
        none = table.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error"))
        return none.limit(0), None
    staged = blocks(table, coding.length, settings)
    for _ in range(settings.rounds):
        coding = improve(staged, coding)
    return with_label_errors(encode(staged, coding)), coding


def decode(code: str, coding: Coding) -> list[int]:
    """The integers that a code stands for, as many as its vector has components."""
    digits = len(code) // len(coding.books)
    entries = [int(code[i : i + digits], 16) for i in range(0, len(code), digits)]
    return [int(x) for p, e in enumerate(entries) for x in coding.books[p, e]][: coding.length]


def digest_column(coding: Coding | None) -> Column:
    return F.lit(coding.digest() if coding else None).cast("string")
