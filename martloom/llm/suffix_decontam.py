"""Benchmark decontamination: suffix arrays of the training text, searched for every test suffix.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of all characters beyond ASCII. A
shard is a run of whole documents of one Spark partition; its suffix array holds the places whose next words
begin like some test suffix (others cannot match), in the order of the words that follow. Test
suffixes are found by binary search; how far a found place goes on verbatim is told by its neighbours among
the sorted test suffixes. A window is ``WINDOW`` consecutive words of an item, or all of a
shorter item. Null texts and texts without words have no hits; items without words have no window;
repeated documents count one by one, a repeated row of the benchmark once. Of equally long matches the first in the document counts,
and of items with that match the smallest (a null id is the largest). A text is held whole, however long; a benchmark is read in slices
of files, so neither driver nor task holds more than one slice. Other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from martloom.llm.rows import STEP_ROWS, by_place, file_system, map_batches, pick, place, ready
from martloom.session import scratch_path

WINDOW = 10
# Words by which suffixes are sorted; longer matches are compared word by word.
DEPTH = 64
# Words of a shard, and characters of the benchmark that are searched for at a time.
SHARD_WORDS = 1 << 21
SLICE_CHARS = 4_000_000
_FILTER_BITS = 22


def letters_only() -> bytes:
    table = bytearray(b" " * 256)
    for b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
        table[b] = b
    for b in range(0x41, 0x5B):
        table[b] = b + 0x20
    return bytes(table)


LETTERS = letters_only()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LETTERS).split()


@dataclass
class TestSet:
    """A slice of the benchmark as numbered words: items one after the other, 0 between them."""

    items: list
    lists: list[list[bytes]]
    window: int = WINDOW
    vocabulary: dict = field(init=False)

    def __post_init__(self):
        self.vocabulary = {}
        number = self.vocabulary
        for words in self.lists:
            for w in words:
                number.setdefault(w, len(number) + 1)
        self.kind = np.dtype(">u2" if len(number) < 65_000 else ">u4")
        self.top = np.iinfo(self.kind).max
        lengths = np.array([len(x) for x in self.lists], dtype=np.int64)
        self.text = np.array([i for words in self.lists for i in (*(number[w] for w in words), 0)], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
        self.depth = int(min(DEPTH, max(lengths, default=1)))
        # every suffix of every item
        self.item = np.repeat(np.arange(len(lengths)), lengths)
        self.at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.start = self.first[self.item] + self.at
        self.left = lengths[self.item] - self.at
        self.item_words = lengths
        # windows, equal ones once, with the items that have them
        size = np.minimum(self.window, lengths)[self.item] if len(lengths) else np.zeros(0, np.int64)
        own = self.left >= size
        self.least = int(size.min()) if len(size) else 1
        keys = pack(self.text, self.start[own], size[own], max(self.window, 1), self.kind)
        self.windows, which = np.unique(keys, return_inverse=True)
        self.size = np.zeros(len(self.windows), dtype=np.int64)
        self.size[which] = size[own]
        pairs = np.unique(np.stack([which, self.item[own]], axis=1), axis=0) if own.any() else np.zeros((0, 2), np.int64)
        self.owner = pairs[:, 1]
        self.owners = np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))
        # all suffixes in their order, whatever their length
        order = suffix_order(self.text)
        self.sorted = order[self.text[order] > 0]
        place_left, place_item = np.zeros(len(self.text), dtype=np.int64), np.zeros(len(self.text), dtype=np.int64)
        place_left[self.start], place_item[self.start] = self.left, self.item
        self.sorted_left, self.sorted_item = place_left[self.sorted], place_item[self.sorted]
        # first words of suffixes that are at least as long as the shortest window
        self.lead = min(3, self.least)
        self.seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.seen[self.leading(self.text)[self.start[self.left >= self.lead]]] = True

    def leading(self, text: np.ndarray) -> np.ndarray:
        """A hash of the ``lead`` words from each place."""
        padded = np.concatenate([text, np.zeros(3, dtype=np.int64)])
        out = np.zeros(len(text), dtype=np.int64)
        for k, factor in zip(range(self.lead), (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), strict=False):
            out += padded[k : k + len(text)] * factor
        return (out >> 7) & ((1 << _FILTER_BITS) - 1)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        known = self.vocabulary.get
        return np.fromiter((known(w, 0) for w in words), np.int64, len(words))


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of a text in the order of what follows them, by doubling the length that ranks stand for."""
    rank, step = text, 1
    while True:
        after = np.concatenate([rank[step:], np.full(min(step, len(rank)), -1)])
        order = np.lexsort((after, rank))
        new = (np.diff(rank[order]) != 0) | (np.diff(after[order]) != 0)
        if new.all():
            return order
        rank, step = np.zeros(len(text), dtype=np.int64), 2 * step
        rank[order[1:]] = np.cumsum(new)


def pack(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, depth: int, kind: np.dtype) -> np.ndarray:
    """For each start a byte string of the next words, at most ``sizes`` and ``depth`` of them; byte order is word order."""
    out = np.zeros((len(starts), depth), dtype=kind)
    for k in range(depth):
        inside = np.flatnonzero(sizes > k)
        if not len(inside):
            break
        out[inside, k] = text[starts[inside] + k]
    return out.reshape(-1).view(f"S{depth * kind.itemsize}") if len(starts) else np.zeros(0, f"S{depth * kind.itemsize}")


@dataclass
class Hits:
    """A mark per word of the shard, each document's items, and (words, place, item) of each document's longest match; items by number."""

    marks: np.ndarray
    items: list[list[int]]
    best: dict[int, tuple[int, int, int]]


class Shard:
    """Suffix array over the numbered words of some documents (0: a word that no test has, or a document's end)."""

    def __init__(self, tests: TestSet, documents: list[list[bytes]]):
        self.tests = tests
        self.lengths = np.array([len(d) for d in documents], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.lengths + 1)])
        self.text = np.zeros(int(self.first[-1]) + 1, dtype=np.int64)
        for start, words in zip(self.first.tolist(), documents, strict=False):
            self.text[start : start + len(words)] = tests.numbers(words)
        breaks = np.flatnonzero(self.text == 0)
        within = tests.seen[tests.leading(self.text)] & (self.text > 0)
        starts = np.flatnonzero(within)
        run = breaks[np.searchsorted(breaks, starts)] - starts
        starts, run = starts[run >= tests.lead], run[run >= tests.lead]
        keys = pack(self.text, starts, run, tests.depth, tests.kind)
        order = np.argsort(keys, kind="stable")
        self.suffixes, self.run, self.keys = starts[order], run[order], keys[order]

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each window, the part of the suffix array that begins with it."""
        t = self.tests
        if not len(t.windows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        base = t.windows.view(t.kind).reshape(len(t.windows), -1)
        low = np.zeros((len(base), max(t.depth, base.shape[1])), dtype=t.kind)
        low[:, : base.shape[1]] = base
        high = np.where(np.arange(low.shape[1]) < t.size[:, None], low, t.top).astype(t.kind)
        text = f"S{low.shape[1] * t.kind.itemsize}"
        keys = self.keys.astype(text)
        return np.searchsorted(keys, low.reshape(-1).view(text), "left"), np.searchsorted(keys, high.reshape(-1).view(text), "right")

    def hits(self, lengths: bool = False) -> Hits:
        """Occurrences of windows, found by searching every test suffix that is long enough, equal ones once."""
        t = self.tests
        low, high = self.ranges()
        times = np.maximum(0, high - low)
        window = np.repeat(np.arange(len(times)), times)
        start = self.suffixes[np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        change = np.zeros(len(self.text) + 1, dtype=np.int64)
        np.add.at(change, start, 1)
        np.add.at(change, start + t.size[window], -1)
        found: list[list[int]] = [[] for _ in self.lengths]
        document = np.searchsorted(self.first, start, side="right") - 1
        for d, w in np.unique(np.stack([document, window], axis=1), axis=0).tolist() if len(start) else ():
            found[d].extend(t.owner[t.owners[w] : t.owners[w + 1]].tolist())
        best = self._best(start, window) if lengths else {}
        return Hits(np.cumsum(change)[:-1] > 0, [sorted(set(x)) for x in found], best)

    def _best(self, start: np.ndarray, window: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """Of each document with a hit: words, place and smallest item of its longest verbatim match."""
        if not len(start):
            return {}
        t = self.tests
        places, which = np.unique(start, return_inverse=True)
        size = np.zeros(len(places), dtype=np.int64)
        np.maximum.at(size, which, t.size[window])
        run = self._run(places)
        at = self._bound(places, run, upper=False)
        reach = np.zeros(len(places), dtype=np.int64)
        for near in (at - 1, at):
            inside = np.clip(near, 0, len(t.sorted) - 1)
            common = self._common(t.sorted[inside], t.sorted_left[inside], places, run)
            reach = np.maximum(reach, np.where((near >= 0) & (near < len(t.sorted)), common, 0))
        # below the window's length only whole short items count, which the search has found
        size = np.where(reach >= t.window, reach, size)
        document = np.searchsorted(self.first, places, side="right") - 1
        order = np.lexsort((places, -size, document))
        lead = order[np.flatnonzero(np.diff(document[order], prepend=-1))]
        places, size, document = places[lead], size[lead], document[lead]
        low, high = self._bound(places, size, upper=False), self._bound(places, size, upper=True)
        out, known = {}, {}
        for d, p, n, lo, hi in np.stack([document, places, size, low, high], axis=1).tolist():
            if (lo, hi, n) not in known:
                # a short match counts for items that consist of it; a longer one for all
                own = t.sorted_item[lo:hi]
                known[lo, hi, n] = int(own[(n >= t.window) | (t.item_words[own] == n)].min())
            out[d] = (n, p - int(self.first[d]), known[lo, hi, n])
        return out

    def _run(self, places: np.ndarray) -> np.ndarray:
        """Known words from each place to the next that no test has, or the document's end."""
        breaks = np.flatnonzero(self.text == 0)
        return breaks[np.searchsorted(breaks, places)] - places

    def _bound(self, places: np.ndarray, sizes: np.ndarray, upper: bool) -> np.ndarray:
        """Where the next ``sizes`` words of each place stand among the sorted test suffixes: before or behind those that begin with them."""
        t = self.tests
        low, high = np.zeros(len(places), dtype=np.int64), np.full(len(places), len(t.sorted))
        going = np.flatnonzero(low < high)
        while len(going):
            middle = (low[going] + high[going]) // 2
            start, left = t.sorted[middle], t.sorted_left[middle]
            same = self._common(start, left, places[going], sizes[going])
            word = np.where(same < left, t.text[np.minimum(start + same, len(t.text) - 1)], 0)
            less = np.where(same == sizes[going], upper, word < self.text[places[going] + same])
            low[going[less]], high[going[~less]] = middle[less] + 1, middle[~less]
            going = going[low[going] < high[going]]
        return low

    def longest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each test suffix: words of its longest verbatim match, and its first document and place (-1: no match)."""
        t = self.tests
        query = pack(t.text, t.start, t.left, t.depth, t.kind)
        best, at = np.zeros(len(query), dtype=np.int64), np.full(len(query), -1)
        if len(self.keys) and len(query):
            spot = np.searchsorted(self.keys, query)
            for near in (spot - 1, spot):
                valid = (near >= 0) & (near < len(self.keys))
                suffix = np.clip(near, 0, len(self.keys) - 1)
                # neighbours with equal keys begin with the first of them; beyond the depth each is compared
                size = self._common(t.start, t.left, self.suffixes[suffix], self.run[suffix])
                better = valid & (size > best)
                best[better], at[better] = size[better], suffix[better]
            if max(self.run.max(), t.left.max()) > t.depth:
                low, high = np.searchsorted(self.keys, query, "left"), np.searchsorted(self.keys, query, "right")
                for q in np.flatnonzero((best >= t.depth) & (high - low > 1)).tolist():
                    some = np.arange(low[q], high[q])
                    size = self._common(np.full(len(some), t.start[q]), np.full(len(some), t.left[q]), self.suffixes[some], self.run[some])
                    best[q], at[q] = size.max(), some[np.argmax(size)]
        start = np.where(at >= 0, self.suffixes[at] if len(self.suffixes) else 0, -1)
        document = np.where(at >= 0, np.searchsorted(self.first, start, side="right") - 1, -1)
        return best, document, np.where(at >= 0, start - self.first[np.maximum(document, 0)], -1)

    def _common(self, start: np.ndarray, left: np.ndarray, suffix: np.ndarray, run: np.ndarray) -> np.ndarray:
        most, out = np.minimum(left, run), np.zeros(len(start), dtype=np.int64)
        going = np.arange(len(start))
        while len(going):
            going = going[out[going] < most[going]]
            same = self.tests.text[start[going] + out[going]] == self.text[suffix[going] + out[going]]
            going = going[same]
            out[going] += 1
        return out


@dataclass(frozen=True)
class Slices:
    """A benchmark in slices of files; iterating reads one after the other."""

    path: str
    count: int
    window: int

    def __iter__(self):
        for k in range(self.count):
            if (self.path, k) not in _LAST:
                _LAST.clear()
                _LAST[self.path, k] = self._read(k)
            yield _LAST[self.path, k]

    def _read(self, k: int) -> TestSet:
        from pyarrow import fs, parquet

        files, root = file_system(self.path)
        known = files.get_file_info(fs.FileSelector(f"{root}/slice={k}", allow_not_found=True))
        rows = []
        for name in sorted(f.path for f in known if f.path.endswith(".parquet")):
            with files.open_input_file(name) as file:
                rows += zip(*(c.to_pylist() for c in parquet.ParquetFile(file).read(["item", "text"]).columns), strict=True)
        found = [(i, words) for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])) if (words := words_of(text))]
        return TestSet([i for i, _ in found], [words for _, words in found], self.window)


# The slice that a Python worker has read last; with one slice it is read once.
_LAST: dict[tuple[str, int], TestSet] = {}


def test_sets(benchmark: DataFrame, item: str = "item_id", text: str = "text", slice_chars: int = SLICE_CHARS, window: int = WINDOW) -> Slices:
    """The benchmark, distinct rows of it, written to the shared folder in slices of bounded size."""
    rows = pick(benchmark, item, text).toDF("item", "text").distinct()  # else all repeats of a row are in one slice
    size = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    count, path = max(1, -(-size // slice_chars)), scratch_path(benchmark.sparkSession, "benchmark")
    cut = rows.where("text is not null").withColumn("slice", F.pmod(F.xxhash64("item", "text"), F.lit(count)))
    cut.repartition("slice").write.partitionBy("slice").parquet(path)
    return Slices(path, count, window)


def _shards(batches, column: int):
    """Batches' rows in shards of about ``SHARD_WORDS`` words."""
    held, documents, size = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, STEP_ROWS):
            part = batch.slice(at, STEP_ROWS)
            held.append(part)
            for value in part.column(column).to_pylist():
                documents.append(words_of(value))
                size += len(documents[-1])
            if size >= SHARD_WORDS:
                yield held, documents
                held, documents, size = [], [], 0
    if documents:
        yield held, documents


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """(key, n_words, n_hit, items, spans, longest, longest_place, longest_item) of every row.

    ``items`` are sorted strings, ``spans`` ranges of words that are hit; ``longest`` words from word ``longest_place`` on are the longest
    verbatim match with an item, none: 0 and nulls. One operator reads the slices in turn; nothing is shuffled.
    """
    ready(docs.sparkSession)
    rows, kind = pick(docs, key, text), dict(pick(benchmark, item).dtypes)[item]
    schema = StructType.fromDDL("n_words long, items array<string>, spans array<array<long>>, longest long, longest_place long").add(
        "longest_item", pick(benchmark, item).schema[0].dataType
    )
    schema = StructType([rows.schema[0], *schema.fields])
    found = rows.mapInArrow(_search(test_sets(benchmark, item, text), schema), schema)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(key, "n_words", hit.alias("n_hit"), "items", "spans", "longest", "longest_place", F.col("longest_item").cast(kind))


def _search(slices: Slices, schema):
    def run(batches):
        kinds = to_arrow_schema(schema)
        for held, documents in _shards(batches, 1):
            items, spans, best = ([d() for _ in documents] for d in (set, list, lambda: None))
            for tests in slices:
                shard = Shard(tests, documents)
                hits = shard.hits(lengths=True)
                for d, (size, at, number) in hits.best.items():
                    start, own = int(shard.first[d]), tests.items[number]
                    items[d].update(str(tests.items[i]) for i in hits.items[d])
                    spans[d] = joined(hits.marks[start : start + len(documents[d])], spans[d])
                    told = (-size, at, own is None, own)
                    best[d] = told if best[d] is None else min(best[d], told, key=lambda x: x if x[3] is not None else x[:3])
            told = [b or (0, None, True, None) for b in best]
            arrays = [
                pa.Table.from_batches(held).column(0),
                *([*map(len, documents)], [*map(sorted, items)], spans, [-b[0] for b in told], [b[1] for b in told], [b[3] for b in told]),
            ]
            arrays = [a if isinstance(a, pa.ChunkedArray) else pa.array(a, type=t) for a, t in zip(arrays, kinds.types, strict=True)]
            yield from pa.Table.from_arrays(arrays, schema=kinds).to_batches()

    return run


def joined(marks: np.ndarray, known: list[list[int]]) -> list[list[int]]:
    """Ranges of marked words, together with the ranges found before."""
    marks = marks.copy()
    for low, high in known:
        marks[low:high] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return edges.reshape(-1, 2).tolist()


def longest_matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """(item, item_word, words, key, doc_word): of every test suffix the longest verbatim match in all documents.

    Matches shorter than the shortest window (or three words) are left out. Ties go to the smallest key and place.
    Every shard hands on its best; they are combined on the way to the result.
    """
    kinds = dict(pick(docs, key).dtypes) | dict(pick(benchmark, item).dtypes)
    slices = test_sets(benchmark, item, text)

    def told(keys: list, documents: list):
        for tests in slices:
            best, document, at = Shard(tests, documents).longest()
            some = np.flatnonzero(best >= tests.lead)
            yield [
                [tests.items[i] for i in tests.item[some]], tests.at[some].tolist(), best[some].tolist(),
                [keys[d] for d in document[some]], at[some].tolist(),
            ]

    def work(steps):
        keys, documents, size = [], [], 0
        for new, texts in steps:
            keys += new
            documents += map(words_of, texts)
            size += sum(map(len, documents[-len(new) :]))
            if size >= SHARD_WORDS:
                yield from told(keys, documents)
                keys, documents, size = [], [], 0
        if documents:
            yield from told(keys, documents)

    out = map_batches(pick(docs, key, text), f"{item} {kinds[item]}, item_word long, words long, {key} {kinds[key]}, doc_word long", work)
    least = F.min(F.struct((-F.col("words")).alias("less"), F.col(key).alias("k"), F.col("doc_word").alias("w")))
    return out.groupBy(item, "item_word").agg(least.alias("b")).select(
        item, "item_word", (-F.col("b.less")).alias("words"), F.col("b.k").alias(key), F.col("b.w").alias("doc_word")
    )


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """Documents without an occurrence of any window, with all columns."""
    ready(docs.sparkSession)
    at, plain, slices = place(docs, text), by_place(docs), test_sets(benchmark, item, text)

    def run(batches):
        for held, documents in _shards(batches, at):
            clean = np.ones(len(documents), dtype=bool)
            for tests in slices:
                clean &= [not items for items in Shard(tests, documents).hits().items]
            yield from pa.Table.from_batches(held).filter(pa.array(clean)).to_batches()

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
