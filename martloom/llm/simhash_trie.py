"""SimHash near copies: fingerprints, and a self-join of their binary trie.

A fingerprint bit is set if more than half of a text's shingle hashes set it. Null, empty and blank
texts have fingerprint 0 and are linked like any other. Equal fingerprints are one entry of the trie,
so repeated rows and copies cost nothing there. A null key never becomes a component's id unless the
whole component has no other; ties for the smallest key go to the smaller text hash. A bit set in exactly half of
the hashes is not set. A text is held whole, with eight bytes a word, however long. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from martloom.llm.components import components
from martloom.llm.rows import by_place, map_batches, pick, place, ready
from martloom.session import stage

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42

# A block of the trie has at most this many fingerprints, or the table's share below if that is more.
BLOCK = 4096
BLOCK_SHARE = 16384
# Bits by which an oversized block is cut further.
CUT_BITS = 8
FIRST_CUT_BITS = 12
# Pairs of nodes that a task expands at a time.
FRONT = 1 << 18


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of one text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    span = min(shingle_words, len(words))
    starts = np.concatenate([[0], ends[: len(words) - span]]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, (ends[span - 1 :] - 1).tolist(), strict=True)]
    return majority(np.array(hashes, dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(key, ``text_hash``, ``fp``) of every row; ``fp`` holds the unsigned bits in a signed long."""
    rows = pick(docs, key, text).withColumn("text_hash", F.xxhash64(text)).select(key, "text_hash", text)

    def work(steps):
        for keys, hashes, texts in steps:
            marks = np.array([fingerprint(t, shingle_words) for t in texts], dtype=np.uint64).view(np.int64)
            yield [keys, hashes, marks.tolist()]

    return map_batches(rows, f"{key} {dict(rows.dtypes)[key]}, text_hash long, fp long", work)


def trie_links(left: np.ndarray, right: np.ndarray | None = None, max_bits: int = MAX_BITS):
    """Index pairs of fingerprints at most ``max_bits`` apart, as arrays, piece by piece.

    Both sides are sorted and without repeats; without ``right`` the left side is joined with
    itself, and each pair comes once. A node of the trie is a range of the sorted side whose
    members agree on the bits read so far. Pairs of nodes are taken down together, a bit at a
    time; a pair whose differing bits exceed the budget is dropped with all that is below it.
    """
    own = right is None
    right = left if own else right
    if not len(left) or not len(right):
        return
    ones = {}

    def split(side: str, values: np.ndarray, depth: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if (side, depth) not in ones:
            bit = (values >> np.uint64(63 - depth)) & np.uint64(1)
            ones[side, depth] = np.concatenate([[0], np.cumsum(bit, dtype=np.int32)])
        table = ones[side, depth]
        return hi - (table[hi] - table[lo])

    first = np.array([[0], [len(left)], [0], [len(right)], [0]], dtype=np.int32)
    todo = [(0, first)]
    while todo:
        depth, (a0, a2, b0, b2, bits) = todo.pop()
        ended = ((a2 - a0 == 1) & (b2 - b0 == 1)) if depth < 64 else np.ones(len(a0), dtype=bool)
        if ended.any():
            i, j = a0[ended], b0[ended]
            near = np.bitwise_count(left[i] ^ right[j]) <= max_bits
            if own:
                near &= i < j
            yield i[near], j[near]
            a0, a2, b0, b2, bits = (x[~ended] for x in (a0, a2, b0, b2, bits))
        if not len(a0):
            continue
        a1 = split("left", left, depth, a0, a2)
        b1 = split("right", right, depth, b0, b2)
        children = [(a0, a1, b0, b1, bits), (a1, a2, b1, b2, bits), (a0, a1, b1, b2, bits + 1), (a1, a2, b0, b1, bits + 1)]
        front = np.concatenate([np.array(c) for c in children], axis=1)
        alive = (front[0] < front[1]) & (front[2] < front[3]) & (front[4] <= max_bits)
        if own:
            alive &= front[0] <= front[2]
        front = front[:, alive]
        todo += [(depth + 1, front[:, at : at + FRONT]) for at in range(0, front.shape[1], FRONT)]


def forest(size: int, pieces) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest member) that connect the same members as all the pieces' pairs."""
    root = np.arange(size)
    for i, j in pieces:
        while True:
            ri, rj = root[i], root[j]
            apart = ri != rj
            if not apart.any():
                break
            i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
            np.minimum.at(root, np.maximum(ri, rj), np.minimum(ri, rj))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    linked = np.flatnonzero(root != np.arange(size))
    return linked, root[linked]


def blocks(marks: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and depths of trie nodes that cover all fingerprints with a bounded number in each.

    Only counts of prefixes come to the driver, as arrays: at most ``2 ** FIRST_CUT_BITS`` at first, then
    ``2 ** CUT_BITS`` for each node that is still too large, of which there are ``BLOCK_SHARE`` at most.
    """
    most = max(BLOCK, size // BLOCK_SHARE)

    def counted(rows: DataFrame, deep: int) -> tuple[np.ndarray, np.ndarray]:
        shift = 64 - deep
        prefix = F.shiftrightunsigned("fp", shift) if shift else F.col("fp")
        told = rows.groupBy(prefix.alias("p")).count().toArrow()
        return told["p"].to_numpy().view(np.uint64) << np.uint64(shift), told["count"].to_numpy()

    deep = FIRST_CUT_BITS
    found, large = cut([(0, 0)], deep, *counted(marks, deep), most)
    while large:
        known = marks.sparkSession.createDataFrame([(_signed(s) >> (64 - deep),) for s, _ in large], "node long")
        inside = marks.join(known, F.shiftright("fp", 64 - deep) == F.col("node"), "left_semi")
        deep = min(64, deep + CUT_BITS)
        more, large = cut(large, deep, *counted(inside, deep), most)
        found += more
    found.sort()
    return np.array([s for s, _ in found], dtype=np.uint64), np.array([d for _, d in found], dtype=np.int64)


def cut(nodes: list[tuple[int, int]], deep: int, prefixes: np.ndarray, counts: np.ndarray, most: int) -> tuple[list, list]:
    """Nodes below ``nodes`` with at most ``most`` fingerprints, and those at depth ``deep`` that have more.

    A node is a range of the sorted prefixes, so its count is a difference of running sums.
    """
    order = np.argsort(prefixes)
    prefixes, sums = prefixes[order].tolist(), [0, *np.cumsum(counts[order]).tolist()]
    fit, large = [], []
    todo = [(s, d, bisect_left(prefixes, s), bisect_left(prefixes, s + (1 << (64 - d)))) for s, d in nodes]
    while todo:
        start, depth, low, high = todo.pop()
        if low == high:
            continue
        if sums[high] - sums[low] <= most or depth == 64:
            fit.append((start, depth))
        elif depth == deep:
            large.append((start, depth))
        else:
            middle = start | 1 << (63 - depth)
            at = bisect_left(prefixes, middle, low, high)
            todo += [(start, depth + 1, low, at), (middle, depth + 1, at, high)]
    return fit, large


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_blocks(starts: np.ndarray, depths: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i <= j) of blocks whose common prefix bits differ in no more than the budget."""
    firsts, seconds = [], []
    for i, (start, depth) in enumerate(zip(starts, depths, strict=True)):
        shared = np.minimum(depth, depths[i:])
        mask = np.where(shared > 0, ~np.uint64(0) << (64 - np.maximum(shared, 1)).astype(np.uint64), np.uint64(0))
        near = np.flatnonzero(np.bitwise_count((starts[i:] ^ start) & mask) <= max_bits) + i
        firsts.append(np.full(len(near), i))
        seconds.append(near)
    return (np.concatenate(firsts), np.concatenate(seconds)) if firsts else (np.zeros(0, int), np.zeros(0, int))


def links(marks: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) links between distinct fingerprints that connect whatever lies within ``max_bits``.

    The top of the trie is cut into blocks; pairs of blocks that stay within the budget are joined
    in a task each. A task hands on a spanning forest of its links, so a dense ball of near copies
    does not become all its pairs.
    """
    ready(marks.sparkSession)
    size = marks.count()
    starts, depths = blocks(marks, size)
    first, second = near_blocks(starts, depths, max_bits)
    count = max(1, len(starts))
    # for each block, the pairs it takes part in
    owner = np.concatenate([first, second[first != second]])
    joint = np.concatenate([np.arange(len(first)), np.flatnonzero(first != second)])
    order = np.argsort(owner, kind="stable")
    joint, bounds = joint[order], np.searchsorted(owner[order], np.arange(count + 1))
    # some pairs for each of at most 2 * BLOCK_SHARE blocks: tens of MB, whatever the number of documents
    plan = marks.sparkSession.sparkContext.broadcast((starts, joint, bounds, first, second))

    def deal(steps):
        starts, joint, bounds, first, _ = plan.value
        for (values,) in steps:
            block = np.searchsorted(starts, np.array(values, dtype=np.int64).view(np.uint64), side="right") - 1
            times = bounds[block + 1] - bounds[block]
            within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            pair = joint[np.repeat(bounds[block], times) + within]
            yield [pair.tolist(), (np.repeat(block, times) != first[pair]).tolist(), np.repeat(np.array(values, dtype=np.int64), times).tolist()]

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        *_, first, second = plan.value
        unsigned = rows["fp"].to_numpy(np.int64).view(np.uint64)
        other = rows["other"].to_numpy(bool)
        left, right = np.unique(unsigned[~other]), np.unique(unsigned[other])
        if len(right):
            every = np.concatenate([left, right])
            pieces = ((i, j + len(left)) for i, j in trie_links(left, right, max_bits))
        else:
            # a pair of a block with itself has one side; of a pair whose second block is empty nothing comes
            own = first[rows["pair"].iloc[0]] == second[rows["pair"].iloc[0]]
            every, pieces = left, trie_links(left, None, max_bits) if own else ()
        member, root = forest(len(every), pieces)
        return pd.DataFrame({"a": every[member].view(np.int64), "b": every[root].view(np.int64)})

    dealt = map_batches(marks.select("fp"), "pair long, other boolean, fp long", deal)
    return dealt.groupBy("pair").applyInPandas(join, "a long, b long")


def near_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """(key, ``text_hash``, ``fp``, ``component_id``, ``keeper``) of every row.

    ``component_id`` is the smallest key whose fingerprint is reachable by links. ``keeper`` is true
    on the rows of one (key, text) of each component: the smallest, by key, then by text hash.
    """
    signed = stage(fingerprints(docs, key, text, shingle_words), "fingerprints")
    own = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("text_hash").alias("text"))
    marks = stage(signed.groupBy("fp").agg(F.min(own).alias("least")), "marks")
    roots = components(stage(links(marks.select("fp"), max_bits), "near"))
    rooted = marks.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # only components of several fingerprints need to be gathered
    joined = roots.select("root").distinct()
    least = rooted.join(joined, "root", "left_semi").groupBy("root").agg(F.min("least").alias("of_root"))
    labels = rooted.join(least, "root", "left").select("fp", F.coalesce("of_root", "least").alias("first"))
    return signed.join(labels, "fp").select(
        key, "text_hash", "fp", F.col("first.key").alias("component_id"), own.eqNullSafe(F.col("first")).alias("keeper")
    )


def drop_near_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """One document of each component, with all columns; repeated rows of it are one document.

    Texts are shuffled once: rows meet the keepers by (``one``, ``said``), the hashes of key and text, and repeats are
    told by these two and the key, so they are in the same place already. Keys are compared as such, too.
    """
    found = near_copies(docs, key, text, shingle_words, max_bits)
    keep = found.where("keeper").select(F.col(key).alias("keep_key"), F.xxhash64(key).alias("keep_one"), F.col("text_hash").alias("keep_text"))
    names, plain = docs.columns, by_place(docs)
    at = F.col(f"c{place(docs, key)}")
    signed = plain.withColumn("one", F.xxhash64(at)).withColumn("said", F.xxhash64(f"c{place(docs, text)}"))
    equal = F.coalesce(at == F.col("keep_key"), at.isNull() & F.col("keep_key").isNull())
    kept = signed.join(keep.distinct(), (F.col("one") == F.col("keep_one")) & (F.col("said") == F.col("keep_text")) & equal, "left_semi")
    return kept.dropDuplicates(["one", "said", f"c{place(docs, key)}"]).drop("one", "said").toDF(*names)
