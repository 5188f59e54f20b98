import math
from collections import Counter

import numpy as np
import pytest

from martloom.llm import quality_rules as rules
from tests.llm.helpers import GERMAN, clashing, documents, edge_rows, prose


def plain_base(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), failed


@pytest.mark.parametrize(
    "text",
    [None, "", " \n ", "a", "a b a b a b", "x\n\nx\n x", "é#ß b\x1cc\x0bd", "a b c d " * 20, prose(1, 80), "line one\nline two\n" * 4, "|" * 99],
)
def test_base_rules_by_hand(text):
    assert rules.base_rules(text) == plain_base(text)


def test_distance_is_that_of_the_formula():
    p, q = np.array([2.0, 1.0, 1.0]), np.array([0.2, 0.8, 0.0])
    share = p / p.sum()
    kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b, strict=True) if x)
    middle = (share + q) / 2
    assert rules.distances(p[None], q)[0] == pytest.approx(math.sqrt((kl(share, middle) + kl(q, middle)) / 2))
    assert rules.distances(q[None], q)[0] == 0


def test_junk_is_rejected_and_prose_kept(spark):
    good = [(k, prose(k, 150), "en") for k in range(30)] + [(100 + k, prose(k, 150, GERMAN), "de") for k in range(30)]
    draw = np.random.default_rng(0)
    junk = " ".join("".join(draw.choice(list("#%&*0123456789")) for _ in range(6)) for _ in range(150))
    rare = " ".join(f"{a}{b}" for a in "qwxyz" for b in range(40))
    kept = {r.doc_id: r for r in rules.judge(documents(spark, [*good, (900, junk, None), (901, rare, None), (902, prose(1, 10), "en")])).collect()}
    assert all(kept[i].kept for i, *_ in good)
    assert not kept[900].kept and kept[900].class_distance > 0.3
    assert not kept[901].kept
    assert kept[902].base_failed and kept[902].word_distance is None


def test_references_count_every_document(spark):
    known = rules.references(documents(spark, [(1, "The the cat", "en"), (2, "the dog", "en"), (3, "x", None), (4, None, "fr")]))
    words, shares = known.words["en"]
    assert words == [b"the", b"cat", b"dog"] and shares == pytest.approx([0.6, 0.2, 0.2, 0])
    assert known.classes["en"].sum() == pytest.approx(1) and set(known.classes) == {"en"}


def test_edges_and_clashing_columns(spark):
    found = rules.judge(clashing(documents(spark, edge_rows()), "kept", "n_words", "c0")).collect()
    assert len(found) == len(edge_rows())
    assert all(tuple(r)[1:7] == plain_base(t) for r, (_, t, _) in zip(sorted(found, key=str), sorted(edge_rows(), key=lambda e: str((e[0],))), strict=True) if t is None)
    assert rules.judge(documents(spark, [])).collect() == []
