"""Quality rules: word statistics, and how far a text's histograms are from those of its language.

Texts are whole; words are runs of bytes other than ASCII white space. A null or empty text has no
words, fails the base rules and is never compared. Repeated rows get a row each; documents with
equal ids are judged one by one. An empty table gives an empty result, and without any language no
text is compared, so the base rules alone decide. Of a language's equally frequent words the smaller by bytes is the more
common one; of equally near languages the distance alone counts. A text is held whole, however long. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from martloom.llm.rows import map_batches, pick
from martloom.session import drop_scratch, scratch_path, stage

BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"

# Character classes of a text's UTF-8 bytes; continuation bytes belong to their lead byte.
CLASSES = ("lower", "upper", "digit", "blank", "line", "mark", "symbol", "control", "beyond")
SYMBOLS = b"#*$%&|<>"
_CONTINUED = len(CLASSES)

# Pairs of a word and its count that a task keeps before it hands them on.
HELD_WORDS = 300_000
# Shares of a language are ranked in this many parts first, so no task ranks all its words.
RANK_PARTS = 64


@dataclass(frozen=True)
class Limits:
    """Guards and largest accepted Jensen-Shannon distances (base 2, 0 to 1) of the divergence rule."""

    min_chars: int = 200
    max_class_distance: float = 0.30
    min_words: int = 100
    max_word_distance: float = 0.50
    common_words: int = 64


def class_table() -> np.ndarray:
    kind = np.full(256, CLASSES.index("control"))
    kind[0x21:0x7F] = CLASSES.index("mark")
    kind[ord("a") : ord("z") + 1] = CLASSES.index("lower")
    kind[ord("A") : ord("Z") + 1] = CLASSES.index("upper")
    kind[ord("0") : ord("9") + 1] = CLASSES.index("digit")
    kind[[0x20, 0x09]] = CLASSES.index("blank")
    kind[0x0A:0x0E] = CLASSES.index("line")
    kind[list(SYMBOLS)] = CLASSES.index("symbol")
    kind[0x80:0xC0] = _CONTINUED
    kind[0xC0:] = CLASSES.index("beyond")
    return kind


KINDS = class_table()
_TO_CLASS = np.zeros((256, _CONTINUED + 1), dtype=np.int64)
_TO_CLASS[np.arange(256), KINDS] = 1


def class_counts(data: bytes) -> np.ndarray:
    """Code points of each class."""
    return (np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _TO_CLASS)[:_CONTINUED]


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text has twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    windows = pairs[:-1] * len(number) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = np.flatnonzero(windows[order][1:] == windows[order][:-1])
    covered = np.zeros(len(words), dtype=bool)
    starts = np.concatenate([order[same], order[same + 1]])
    for k in range(3):
        covered[starts + k] = True
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.encode().split(b"\n") if x.split(None, 1)]
    return len(lines) - len(set(lines))


def base_rules(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """The columns of ``BASE_SCHEMA`` for one text."""
    data = (text or "").encode()
    words = data.split()
    count, again = len(words), repeated_words(words)
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    points = int(by_byte.sum() - by_byte[0x80:0xC0].sum() - by_byte[0x09:0x0E].sum() - by_byte[0x20])
    failed = count < 50 or 100 * again > 50 * count
    return count, points, int(by_byte[list(SYMBOLS)].sum()), repeated_lines(text) if text else 0, again, failed


def distances(seen: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of every row of counts to one reference distribution."""
    p = seen / np.maximum(seen.sum(axis=1, keepdims=True), 1)
    m = (p + reference) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(reference > 0, reference * np.log2(reference / m), 0).sum(axis=1)
    return np.sqrt(np.maximum(0, (left + right) / 2))


@dataclass(frozen=True)
class References:
    """For each language: shares of the character classes, its common words, and their shares (the rest comes last)."""

    classes: dict[str, np.ndarray]
    words: dict[str, tuple[list[bytes], np.ndarray]]


def references(docs: DataFrame, limits: Limits = Limits(), text: str = "text", lang: str = "lang") -> References:
    """References over all documents that name a language; what comes to the driver is a row per language and common word."""
    known = pick(docs, text, lang).where(F.col(lang).isNotNull() & F.col(text).isNotNull())

    def count(steps):
        classes: dict[str, np.ndarray] = {}
        words: dict[tuple[str, bytes], int] = {}

        def told():
            rows = [(k, None, i, int(n)) for k, counts in classes.items() for i, n in enumerate(counts)]
            rows += [(k, w, -1, n) for (k, w), n in words.items()]
            classes.clear()
            words.clear()
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], [], []]

        for texts, langs in steps:
            for value, k in zip(texts, langs, strict=True):
                data = value.encode()
                classes[k] = classes.get(k, 0) + class_counts(data)
                for w in data.lower().split():
                    words[k, w] = words.get((k, w), 0) + 1
                if len(words) > HELD_WORDS:
                    yield told()
        yield told()

    counted = map_batches(known, "lang string, word binary, class int, n long", count).groupBy("lang", "word", "class").agg(F.sum("n").alias("n"))
    path = scratch_path(docs.sparkSession, "word_counts")
    counted = stage(counted, "word_counts", path)  # read three times below
    part = Window.partitionBy("lang", "part").orderBy(F.desc("n"), "word")
    whole = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    only_words = counted.where("class = -1").withColumn("part", F.pmod(F.xxhash64("word"), F.lit(RANK_PARTS)))
    totals = only_words.groupBy("lang", "part").agg(F.sum("n").alias("all"))
    first = only_words.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= limits.common_words)
    top = first.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= limits.common_words)
    rows = (
        counted.where("class >= 0").select("lang", F.lit(None).cast("binary").alias("word"), "class", "n")
        .unionByName(top.select("lang", "word", F.lit(-1).alias("class"), "n"))
        .unionByName(totals.groupBy("lang").agg(F.sum("all").alias("n")).select("lang", F.lit(None).cast("binary").alias("word"), F.lit(-2).alias("class"), "n"))
        .collect()
    )
    drop_scratch(docs.sparkSession, path)
    classes: dict[str, np.ndarray] = {}
    words: dict[str, list[tuple[bytes, int]]] = {}
    totals_by = {r["lang"]: r["n"] for r in rows if r["class"] == -2}
    for r in rows:
        if r["class"] >= 0:
            classes.setdefault(r["lang"], np.zeros(_CONTINUED))[r["class"]] = r["n"]
        elif r["class"] == -1:
            words.setdefault(r["lang"], []).append((bytes(r["word"]), r["n"]))
    shares = {}
    for k, found in words.items():
        found.sort(key=lambda x: (-x[1], x[0]))
        counts = np.array([n for _, n in found] + [totals_by[k] - sum(n for _, n in found)], dtype=float)
        shares[k] = ([w for w, _ in found], counts / counts.sum())
    return References({k: v / max(1, v.sum()) for k, v in classes.items()}, shares)


class Divergence:
    """Distances of texts to the nearest language's character classes and common words."""

    def __init__(self, known: References, limits: Limits):
        self.known, self.limits = known, limits
        vocabulary = sorted({w for found, _ in known.words.values() for w in found})
        self.number = {w: i for i, w in enumerate(vocabulary)}
        self.places = {k: np.array([self.number[w] for w in found]) for k, (found, _) in known.words.items()}

    def __call__(self, texts: list[str | None]) -> list[list]:
        """Class distance, word distance (null where a guard holds the comparison back) and the verdict."""
        size, rest = len(self.number), len(self.number)
        classes = np.zeros((len(texts), _CONTINUED))
        words = np.zeros((len(texts), size + 1))
        for i, value in enumerate(texts):
            data = (value or "").encode()
            classes[i] = class_counts(data)
            found = [self.number.get(w, rest) for w in data.lower().split()]
            words[i] = np.bincount(np.array(found, dtype=np.int64), minlength=size + 1)
        far = [distances(classes, ref) for ref in self.known.classes.values()]
        by_class = np.min(far, axis=0) if far else np.zeros(len(texts))
        far = []
        for k, (_, ref) in self.known.words.items():
            common = words[:, self.places[k]]
            far.append(distances(np.column_stack([common, words.sum(axis=1) - common.sum(axis=1)]), ref))
        by_word = np.min(far, axis=0) if far else np.zeros(len(texts))
        compared = bool(self.known.classes)
        long_classes = compared & (classes.sum(axis=1) >= self.limits.min_chars)
        long_words = compared & (words.sum(axis=1) >= self.limits.min_words)
        bad = (long_classes & (by_class > self.limits.max_class_distance)) | (long_words & (by_word > self.limits.max_word_distance))
        shown = [[float(d) if ok else None for d, ok in zip(x, y, strict=True)] for x, y in ((by_class, long_classes), (by_word, long_words))]
        return [*shown, (~bad).tolist()]


def judge(docs: DataFrame, limits: Limits = Limits(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """A row per document: key, the base columns, both distances and ``kept``."""
    known = references(docs, limits, text, lang)
    rows = pick(docs, key, text)

    def work(steps):
        verdict = Divergence(known, limits)
        for keys, texts in steps:
            base = list(zip(*map(base_rules, texts), strict=True)) if texts else [[]] * 6
            by_class, by_word, alike = verdict(texts)
            kept = [not failed and ok for failed, ok in zip(base[5], alike, strict=True)]
            yield [keys, *map(list, base), by_class, by_word, kept]

    schema = f"{key} {dict(rows.dtypes)[key]}, {BASE_SCHEMA}, class_distance double, word_distance double, kept boolean"
    return map_batches(rows, schema, work)
