import random
import re
from itertools import permutations

import numpy as np

from martloom.llm import filter_audit as fa
from tests.llm.helpers import clashing, documents, edge_rows, prose

LABELS = "doc_id long, quality int, toxic int"


def plain_fails(rows):
    out = []
    for doc_id, text, *_ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = doc_id is not None and any(o is not None and o < doc_id and (x or "") == t for o, x, *_ in rows)
        capitals = len(re.findall("[A-Z]", t))
        out.append((len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * capitals > 10 * len(t), bool(re.search("[#$%&*|]", t)), copy))
    return out


def plain_report(rows, labels):
    fails = plain_fails(rows)
    good = {k for k, q, _ in labels if q == 1}
    toxic = {k for k, _, t in labels if t == 1}
    out, removed_by = {}, {}
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order):
                i = "ABCDE".index(name)
                gone = [k for k, f in left if f[i]]
                left = [(k, f) for k, f in left if not f[i]]
                failing = sum(f[i] for _, f in own)
                single = sum(f[i] and sum(f) == 1 for _, f in own)
                in_ = lambda ids: sum(k is not None and k in ids for k in gone)  # noqa: E731, B023
                out[part, "".join(order), step + 1] = (len(left), len(gone), failing - len(gone), single, in_(good), in_(toxic))
                removed_by[part, name] = removed_by.get((part, name), 0) + len(gone)
    return sorted((*k, *v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def corpus():
    draw = random.Random(3)
    rows = []
    for i in range(150):
        base = prose(draw.randrange(20), draw.choice([20, 99, 100, 150, 400]))
        text = draw.choice([base, base.upper(), base + " #x", " ".join(f"{w}{j}" for j, w in enumerate(base.split()))])
        rows.append((draw.choice([i, i, i, i // 2, None]), text, draw.choice(["en", "de", None, ""])))
    return rows + rows[:10]


def as_rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_by_running_the_filters(spark):
    rows = corpus()
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 150, 2)] + [(4, 1, 1), (4, None, 0), (None, 1, 1), (5, None, None), (9999, 1, 1)]
    labels = [(k, q, None if t is None else int(t)) for k, q, t in labels]
    got = as_rows(fa.audit(documents(spark, rows), spark.createDataFrame(labels, LABELS)))
    assert got == plain_report(rows, labels)
    assert any(r[3] and r[5] and r[6] for r in got)


def test_edges(spark):
    rows = edge_rows()
    labels = spark.createDataFrame([], LABELS)
    got = as_rows(fa.audit(clashing(documents(spark, rows), "part", "mask", "n", "digest"), clashing(labels, "n", "text")))
    assert got == plain_report(rows, [])
    assert fa.audit(documents(spark, []), labels).collect() == []


def test_one_text_holds_a_third(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}", "en") for i in range(300)]
    assert as_rows(fa.audit(documents(spark, rows), spark.createDataFrame([], LABELS))) == plain_report(rows, [])


def test_contraction_is_a_sum_over_selected_halves():
    tensor = np.random.default_rng(1).integers(0, 9, (3, 2, 2, 2))
    select = fa.selections("XYZ")
    for which in (select.kept, select.removed, select.failing, select.alone):
        got = fa.contract(tensor, which)
        for row, (x, y, z) in zip(got, which):
            assert (row == np.einsum("mxyz,x,y,z->m", tensor, x, y, z)).all()
    assert len(select.orders) == 6 and (fa.contract(tensor, select.kept[2:3]) == tensor[:, 0, 0, 0]).all()


def test_other_filters(spark):
    cells = spark.createDataFrame([("p", True, False, 3, 1, 0), ("p", True, True, 2, 0, 1), ("p", True, True, 1, 1, 1)], "part string, U boolean, V boolean, rows long, good long, toxic long")
    got = as_rows(fa.interactions(cells, "UV"))
    assert got == [("p", "UV", 1, 0, 6, 0, 3, 2, 2, 9), ("p", "UV", 2, 0, 0, 3, 0, 0, 0, 3), ("p", "VU", 1, 3, 3, 0, 0, 1, 2, 3), ("p", "VU", 2, 0, 3, 3, 3, 1, 0, 9)]
