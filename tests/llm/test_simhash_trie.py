import random
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from martloom.llm import simhash_trie as sim
from martloom.llm.components import components
from tests.llm.helpers import clashing, documents, edge_rows, prose


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(marks, bits=2):
    """Components by comparing all pairs."""
    parent = {m: m for m in marks}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    listed = list(parent)
    for i, a in enumerate(listed):
        for b in listed[:i]:
            if (a ^ b).bit_count() <= bits:
                parent[find(a)] = find(b)
    return {m: find(m) for m in marks}


def plain_components(rows, bits=2):
    marks = [plain_fingerprint(t) for _, t in rows]
    root = plain_roots(marks, bits)
    least = {}
    for (i, _), m in zip(rows, marks, strict=True):
        if i is not None:
            least[root[m]] = min(i, least.get(root[m], i))
    return sorted(((i, m, least.get(root[m])) for (i, _), m in zip(rows, marks, strict=True)), key=str)


def found_components(df):
    return sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in sim.near_copies(df).collect()), key=str)


@pytest.mark.parametrize("text", [None, "", "One", "one two", "A b c a b c", prose(3, 300), "é ß ü 梦 x"])
def test_fingerprint(text):
    assert sim.fingerprint(text) == plain_fingerprint(text)


def test_shingle_hash_is_that_of_spark(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"one two three", 42)


def ball(seed, count):
    """Fingerprints around a few centres, so many are near."""
    draw = random.Random(seed)
    centres = [draw.getrandbits(64) for _ in range(4)]
    out = set()
    while len(out) < count:
        x = draw.choice(centres)
        for _ in range(draw.randrange(6)):
            x ^= 1 << draw.randrange(64)
        out.add(x)
    return np.array(sorted(out), dtype=np.uint64)


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_trie_links_are_all_near_pairs(bits):
    left, right = ball(1, 300), ball(2, 200)
    own = {(int(i), int(j)) for a, b in sim.trie_links(left, None, bits) for i, j in zip(a, b, strict=True)}
    assert own == {(i, j) for i in range(300) for j in range(i + 1, 300) if (int(left[i]) ^ int(left[j])).bit_count() <= bits}
    both = np.array(sorted({*left.tolist()[::3], *right.tolist()}), dtype=np.uint64)
    met = [(int(i), int(j)) for a, b in sim.trie_links(left, both, bits) for i, j in zip(a, b, strict=True)]
    assert len(met) == len(set(met))
    assert set(met) == {(i, j) for i in range(300) for j in range(len(both)) if (int(left[i]) ^ int(both[j])).bit_count() <= bits}


def test_blocks_cut_dense_parts_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(sim, "BLOCK", 16)
    marks = {*ball(5, 500).tolist(), *(1 << 63 | k for k in range(200)), 0, (1 << 64) - 1}
    df = spark.createDataFrame([(sim._signed(m),) for m in marks], "fp long")
    starts, depths = sim.blocks(df, len(marks))
    assert starts[0] == 0 and len(starts) > 30
    sizes = np.bincount(np.searchsorted(starts, np.array(sorted(marks), dtype=np.uint64), side="right") - 1)
    assert sizes.max() <= 16
    root = plain_roots(list(marks))
    parent = {m: m for m in marks}
    for r in components(sim.links(df)).collect():
        parent[r.node % (1 << 64)] = r.root % (1 << 64)
    groups = lambda d: sorted(sorted(m for m in marks if d[m] == r) for r in set(d.values()))
    assert groups(parent) == groups(root)


def test_cutting_thousands_of_large_nodes_takes_seconds():
    draw = np.random.default_rng(3)
    prefixes = np.unique(draw.integers(0, 1 << 20, 1 << 20, dtype=np.uint64)) << np.uint64(44)
    nodes = [(k << 52, 12) for k in range(1 << 12)]
    began = time.monotonic()
    fit, large = sim.cut(nodes, 20, prefixes, np.full(len(prefixes), 3), 5)
    assert time.monotonic() - began < 20
    assert not large and {d for _, d in fit} <= set(range(12, 21))
    starts = np.array(sorted(s for s, _ in fit), dtype=np.uint64)
    assert np.bincount(np.searchsorted(starts, prefixes, side="right") - 1).max() * 3 <= 5
    assert sim.cut([(0, 0)], 12, prefixes[:1], np.array([9]), 5) == ([], [(int(prefixes[0]) >> 52 << 52, 12)])


def test_texts_of_kept_rows_are_shuffled_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sim.drop_near_copies(documents(spark, near_rows()))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning(one" in line]
    assert len(shuffles) == 1 and "SortMergeJoin" in plan


def test_components_of_chains_stars_and_hot_nodes(spark):
    chain = [(k, k + 1) for k in range(60)]
    star = [(1000 + k, 500) for k in range(300)]
    df = spark.createDataFrame([*chain, *star, (7, 7), (2000, 1999), (1999, 2000)], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, **{1000 + k: 500 for k in range(300)}, 2000: 1999}
    assert components(df.limit(0)).collect() == []


def near_rows():
    base = [prose(k, 200) for k in range(6)]
    rows = [(10 * k, t) for k, t in enumerate(base)]
    rows += [(100 + k, base[k % 3] + f" tail{k}") for k in range(12)]
    rows += [(300 + k, base[0]) for k in range(40)]
    return [*rows, (300, base[0]), (500, base[0].upper()), (None, base[1]), (501, None), (502, ""), (503, "  ")]


def test_near_copies_by_brute_force(spark):
    rows = near_rows()
    assert found_components(documents(spark, rows)) == plain_components(rows)


def test_edges_and_clashing_columns(spark):
    rows = [(i, t) for i, t, _ in edge_rows()]
    assert found_components(clashing(documents(spark, rows), "fp", "component_id", "root")) == plain_components(rows)
    assert sim.near_copies(documents(spark, [])).collect() == []


def test_one_document_of_each_group_stays(spark):
    rows = near_rows()
    docs = clashing(documents(spark, rows), "said", "keep_key")
    kept = sim.drop_near_copies(docs)
    assert kept.columns == docs.columns
    groups = {}
    for i, m, c in plain_components(rows):
        groups.setdefault(c if c is not None else m, []).append(i)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(x for x in g if x is not None) for g in groups.values())
    assert sim.drop_near_copies(documents(spark, [(None, "a b"), (None, "a b"), (None, "quite another text")])).count() == 2
    assert sim.drop_near_copies(documents(spark, [])).collect() == []
