"""How filters of documents interact: what each removes in every order in which they can run.

Every document passes or fails each of k filters, so a part of the corpus is a tensor of 2x...x2
counts, one axis for each filter. Whatever an order of the filters keeps, removes or finds removed
already is a contraction of that tensor: along each axis it selects pass, fail or all. Spark counts
the cells in one pass over the texts; the contractions are one ``einsum`` for each part.

Copies are found by digest. Equal texts pass and fail the other filters alike, so rows are counted
by digest, part, cell and label first (combined on the map side), and only these counts meet by
digest: a text that holds a third of the table is a few rows by then. Texts are never shuffled.

Defined results: null texts are empty texts; null parts are the part ""; a document without an id has
no smaller one and is none, so it never fails as a copy; rows that repeat id and text are counted each,
and as copies of smaller ids only; an id that is labelled more than once has a label if any row says so, ids without
labels have none; texts of any length are judged whole; words that tie in number with a limit pass; a table
without rows has no parts and gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from martloom.llm.rows import pick, ready

# What a contraction selects along an axis of (pass, fail).
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)

COUNTS = ("rows", "good", "toxic")
REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


@dataclass(frozen=True)
class Limits:
    min_words: int = 100
    distinct_percent: int = 80
    capital_percent: int = 10
    symbols: str = "[#$%&*|]"


COPY = "E"


def failures(text: Column, limits: Limits) -> dict[str, Column]:
    """Which of the filters that look at one text alone it fails."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    size, length = (lambda a: F.size(a).cast("bigint")), (lambda t: F.length(t).cast("bigint"))  # times 100 they may leave the range of int
    return {
        "A": F.size(words) < limits.min_words,
        "B": size(F.array_distinct(words)) * 100 < size(words) * limits.distinct_percent,
        "C": length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > length(text) * limits.capital_percent,
        "D": text.rlike(limits.symbols),
    }


def cells(docs: DataFrame, labels: DataFrame, limits: Limits | None = None) -> DataFrame:
    """(part, A, B, C, D, E, rows, good, toxic): documents by part and by the filters that they fail."""
    table = pick(docs, "doc_id", "text", "lang").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("part"))
    fails = failures(F.col("text"), limits or Limits())
    mask = reduce(lambda x, y: x + y, (f.cast("int") * (1 << i) for i, f in enumerate(fails.values())))
    judged = table.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), mask.alias("mask"))
    rows = judged.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    counted = _copies(_labelled(rows, labels))
    flags = [(F.col("mask").bitwiseAND(1 << i) != 0).alias(name) for i, name in enumerate(fails)]
    return counted.select("part", *flags, F.inline(_both()))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Counted rows with ``good`` and ``toxic``, 0 or 1."""
    flag = lambda c: F.max((F.coalesce(c, F.lit(0)) == 1).cast("int")).alias(c)
    known = pick(labels, "doc_id", "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    # rows without an id match nothing, so they are dealt out by their texts
    deal = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("bigint")).alias("deal")
    joined = rows.select("*", deal).join(known.withColumn("deal", F.lit(0).cast("bigint")), ["doc_id", "deal"], "left")
    return joined.drop("deal").fillna(0, ["quality", "toxic"])


def _copies(rows: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic and those that are no copies) from rows that are distinct by id and digest."""
    same = rows.groupBy("digest", "part", "mask", "quality", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        F.min("doc_id").alias("first"),
        F.min_by("n", "doc_id").alias("at_first"),
    )
    least = F.min("first").over(W.partitionBy("digest"))
    own = F.col("nameless") + F.when(F.col("first") == F.col("least"), F.col("at_first")).otherwise(0)
    known = same.withColumn("least", least).withColumn("own", own)
    sums = [F.sum(F.col(n) * F.col(by) if by else F.col(n)).alias(f"{n}_{by}") for n in ("n", "own") for by in ("", "quality", "toxic")]
    return known.groupBy("part", "mask").agg(*sums)


def _both() -> Column:
    """The counts of a cell of the other filters, split into copies and others."""
    names = ("", "quality", "toxic")
    own = [F.col(f"own_{x}") for x in names]
    copy = [F.col(f"n_{x}") - F.col(f"own_{x}") for x in names]
    return F.array(*(F.struct(F.lit(e).alias(COPY), *(v.alias(c) for v, c in zip(values, COUNTS))) for e, values in ((False, own), (True, copy))))


@dataclass(frozen=True)
class Selections:
    """For every order and step the selections along each axis: arrays of (orders * steps, filters, 2)."""

    orders: list[str]
    kept: np.ndarray
    removed: np.ndarray
    failing: np.ndarray
    alone: np.ndarray
    filter_at: np.ndarray


def selections(filters: str) -> Selections:
    orders, kept, removed, failing, alone, at = ["".join(o) for o in permutations(filters)], [], [], [], [], []
    for order in orders:
        for step, name in enumerate(order):
            before = order[:step]
            kept.append([PASS if f in before or f == name else ALL for f in filters])
            removed.append([FAIL if f == name else PASS if f in before else ALL for f in filters])
            failing.append([FAIL if f == name else ALL for f in filters])
            alone.append([FAIL if f == name else PASS for f in filters])
            at.append(filters.index(name))
    return Selections(orders, *(np.array(s, dtype=np.int64) for s in (kept, removed, failing, alone)), np.array(at))


def contract(tensor: np.ndarray, select: np.ndarray) -> np.ndarray:
    """(selections, counts): the tensor of (counts, 2, ..., 2) summed up along the selected halves of its axes."""
    axes = tensor.ndim - 1
    operands = [tensor, [0, *range(2, axes + 2)]]
    for i in range(axes):
        operands += [select[:, i], [1, i + 2]]
    return np.einsum(*operands, [1, 0], optimize="greedy")


def reshape(part: pd.DataFrame, filters: str) -> np.ndarray:
    """The tensor of (counts, 2, ..., 2) of one part's cells; cells that are not there count nothing."""
    flat = np.zeros((2 ** len(filters), len(COUNTS)), dtype=np.int64)
    index = sum(part[f].to_numpy().astype(np.int64) << (len(filters) - 1 - i) for i, f in enumerate(filters))
    np.add.at(flat, index, part[list(COUNTS)].to_numpy(dtype=np.int64))
    return np.ascontiguousarray(flat.T).reshape(len(COUNTS), *[2] * len(filters))


def report(part: str, tensor: np.ndarray, filters: str, select: Selections) -> pd.DataFrame:
    """All orders and steps of one part."""
    steps = len(filters)
    kept, lost, failing, alone = (contract(tensor, s) for s in (select.kept, select.removed, select.failing, select.alone))
    by_filter = np.zeros(steps, dtype=np.int64)
    np.add.at(by_filter, select.filter_at, lost[:, 0])
    return pd.DataFrame(
        {
            "part": part,
            "filter_order": np.repeat(select.orders, steps),
            "step": np.tile(np.arange(1, steps + 1, dtype=np.int32), len(select.orders)),
            "kept": kept[:, 0],
            "removed": lost[:, 0],
            "redundant": failing[:, 0] - lost[:, 0],
            "unique_fails": alone[:, 0],
            "good_lost": lost[:, 1],
            "toxic_lost": lost[:, 2],
            "shapley": by_filter[select.filter_at],
        }
    )


def interactions(counted: DataFrame, filters: Sequence[str] = "ABCDE") -> DataFrame:
    """Kept, removed and lost documents of every part, order and step, from a table of cells.

    A part has at most 2 ** filters cells after the sum, and its report has filters! * filters rows.
    """
    ready(counted.sparkSession)
    names = "".join(filters)
    select = selections(names)
    summed = counted.groupBy("part", *names).agg(*(F.sum(c).alias(c) for c in COUNTS))

    def of_part(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return report(key[0], reshape(rows, names), names, select)

    return summed.groupBy("part").applyInPandas(of_part, REPORT)


def audit(docs: DataFrame, labels: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The interactions of the five filters on documents, by language."""
    return interactions(cells(docs, labels, limits))
