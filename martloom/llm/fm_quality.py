"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = logistic(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise
interactions at the cost of one pass over the features. It is fitted on at most ``FIT_ROWS`` labelled
documents of each class (those with the smallest key hashes) and scores every whole text. Null and empty texts have
features of their own and get a score like any other; without labelled rows every score is 0.5.
Repeated rows are scored one by one; in the fit an id counts once, with the text of the smallest digest,
and an id labelled both 0 and 1 counts as 1. A score of just 0.5 is a 1. A text is held whole, however long; its features have a fixed
size. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from martloom.llm.rows import STEP_ROWS, filter_rows, map_batches, pick

# The bound of the labelled sample, for each class.
FIT_ROWS = 6000
WORD_BUCKETS = 1024
STATISTICS = 20
BINS = 6
DIMENSIONS = WORD_BUCKETS + STATISTICS * BINS
FACTORS = 8
EPOCHS = 12
BATCH = 256
RATE = 0.02
DECAY = 1e-5
SEED = 7
REJECT_BELOW = 0.5
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
# Words whose buckets a worker remembers.
_HELD = 400_000


def bucket(word: bytes) -> int:
    return zlib.crc32(word) % WORD_BUCKETS


def features(texts: list[str | None]) -> np.ndarray:
    """A row of ``DIMENSIONS`` numbers per text: word shares (square roots), then soft bins of each statistic."""
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    numbers = np.zeros((len(texts), STATISTICS))
    known: dict[bytes, int] = {}
    for i, value in enumerate(texts):
        data = (value or "").encode()
        words = data.lower().split()
        if len(known) > _HELD:
            known.clear()
        for w in set(words).difference(known):
            known[w] = bucket(w)
        ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        counts = np.bincount(ids, minlength=WORD_BUCKETS)
        out[i, :WORD_BUCKETS] = np.sqrt(counts / max(1, len(words)))
        numbers[i] = statistics(data, words, value)
    centre = np.linspace(0, 1, BINS)
    bins = np.maximum(0, 1 - np.abs(numbers[:, :, None] - centre) * (BINS - 1))
    out[:, WORD_BUCKETS:] = 0.5 * bins.reshape(len(texts), -1)
    return out


def statistics(data: bytes, words: list[bytes], text: str | None) -> np.ndarray:
    """``STATISTICS`` numbers from 0 to 1: lengths, shares of characters, words and lines, and what is missing."""
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size, count = max(1, len(data)), max(1, len(words))
    distinct = len(set(words))
    pairs = max(1, len(words) - 1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    line_count = max(1, len(lines))
    same_next = sum(a == b for a, b in zip(words, words[1:], strict=False))
    upper, lower, digits = by_byte[65:91].sum(), by_byte[97:123].sum(), by_byte[48:58].sum()
    points = size - by_byte[0x80:0xC0].sum()
    return np.minimum(
        [
            np.log1p(len(words)) / 12,
            np.log1p(points) / 14,  # metadata: size of the document
            np.log1p(len(lines)) / 8,
            by_byte[_SYMBOLS].sum() / count,
            4 * by_byte[_SYMBOLS].sum() / size,
            by_byte[ord("|")] / count,
            8 * digits / size,
            4 * upper / size,
            lower / size,
            4 * by_byte[0xC0:].sum() / size,
            (by_byte[ord(".")] + by_byte[ord(",")]) / count,
            8 * by_byte[[33, 63]].sum() / count,
            distinct / count,
            distinct / np.sqrt(count) / 30,
            same_next / pairs,
            1 - len(set(zip(words, words[1:], strict=False))) / pairs,
            1 - len(set(lines)) / line_count if lines else 0,
            len(data) / count / 20,
            len(words) / line_count / 60,
            float(text is None or not words),
        ],
        1,
    )


@dataclass(frozen=True)
class Machine:
    """Bias, linear weights and factors."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        summed = x @ self.factors
        return self.bias + x @ self.linear + 0.5 * (summed**2 - (x**2) @ (self.factors**2)).sum(axis=1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(features(texts)), -30, 30)))


def train(x: np.ndarray, y: np.ndarray) -> Machine:
    """Adam on the logistic loss; classes weigh the same."""
    draw = np.random.default_rng(SEED)
    size = x.shape[1]
    if not len(y):
        return Machine(0.0, np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32))
    share = np.where(y == 1, max(1, (y == 1).sum()), max(1, (y == 0).sum()))
    weight = len(y) / (2 * share)
    parameters = [np.zeros(1), np.zeros(size), draw.normal(0, 0.05, (size, FACTORS))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    step = 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(y))
        for at in range(0, len(y), BATCH):
            some = order[at : at + BATCH]
            rows, step = x[some].astype(np.float64), step + 1
            summed = rows @ parameters[2]
            logit = parameters[0][0] + rows @ parameters[1] + 0.5 * (summed**2 - (rows**2) @ (parameters[2] ** 2)).sum(axis=1)
            slope = weight[some] * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[some]) / len(some)
            pull = rows.T @ (slope[:, None] * summed) - ((rows**2).T @ slope)[:, None] * parameters[2]
            for k, g in enumerate(([slope.sum()], rows.T @ slope, pull)):
                g = np.asarray(g) + DECAY * parameters[k]
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g**2 - v)
                parameters[k] = parameters[k] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Machine(float(parameters[0][0]), parameters[1].astype(np.float32), parameters[2].astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> Machine:
    """Fit on the labelled documents; at most ``rows`` ids of each class are taken, and one row of features of each comes to the driver."""
    marked = pick(labels, key, label).where(F.col(key).isNotNull() & F.col(label).isin(0, 1))
    order = [F.xxhash64(F.col(key)), F.col(key)]
    some = [marked.where(F.col(label) == k).groupBy(key).agg(F.max(label).alias(label)).orderBy(*order).limit(rows) for k in (0, 1)]
    # two bounded lists of keys: at most 2 * rows
    chosen = F.broadcast(some[0].unionByName(some[1]).groupBy(key).agg(F.max(label).alias("mark")))
    found = pick(docs, key, text).join(chosen, key).select(key, "mark", text)

    def work(steps):
        best = {}  # of each chosen key, so at most 2 * rows
        for keys, marks, texts in steps:
            new = {}
            for k, mark, value in zip(keys, marks, texts, strict=True):
                digest = hashlib.blake2b((value or "").encode(), digest_size=16).digest()
                if digest < (new.get(k) or best.get(k) or (b"\xff" * 17,))[0]:
                    new[k] = (digest, mark, value)
            made = features([value for _, _, value in new.values()]).astype(np.float16)
            best.update((k, (digest, mark, x.tobytes())) for (k, (digest, mark, _)), x in zip(new.items(), made, strict=True))
        told = list(best.items())
        for at in range(0, len(told), STEP_ROWS):
            part = told[at : at + STEP_ROWS]
            yield [[k for k, _ in part], *([row[i] for _, row in part] for i in range(3))]

    kind = dict(found.dtypes)
    one = map_batches(found, f"{key} {kind[key]}, digest binary, mark int, x binary", work).groupBy(key)
    seen = one.agg(F.min(F.struct("digest", "mark", "x")).alias("row")).select(key, "row.mark", "row.x").collect()
    seen.sort(key=lambda r: (r[key], r["x"]))
    x = np.array([np.frombuffer(r["x"], np.float16) for r in seen], dtype=np.float32).reshape(-1, DIMENSIONS)
    return train(x, np.array([r["mark"] for r in seen], dtype=np.float64))


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) of every row."""
    rows = pick(docs, key, text)

    def work(steps):
        for keys, texts in steps:
            found = machine.scores(texts)
            yield [keys, found.tolist(), (found >= REJECT_BELOW).astype(int).tolist()]

    return map_batches(rows, f"{key} {dict(rows.dtypes)[key]}, score double, predicted int", work)


def keep_good(docs: DataFrame, machine: Machine, text: str = "text", below: float = REJECT_BELOW) -> DataFrame:
    """Documents that score ``below`` or more."""
    return filter_rows(docs, text, lambda: lambda texts: (machine.scores(texts) >= below).tolist())
