import itertools

import numpy as np
import pytest

from martloom.llm import fm_quality as fm
from tests.llm.helpers import clashing, documents, edge_rows, prose


def junk(seed):
    return " ".join(w + "###" for w in prose(seed, 60).split()) if seed % 2 else "spam spam " * 40


def test_sum_of_squares_is_the_sum_over_pairs():
    draw = np.random.default_rng(0)
    model = fm.Machine(0.3, draw.normal(size=9), draw.normal(size=(9, 4)))
    x = draw.normal(size=(5, 9))
    pairs = [sum(r[i] * r[j] * (model.factors[i] @ model.factors[j]) for i, j in itertools.combinations(range(9), 2)) for r in x]
    assert model.logits(x) == pytest.approx(0.3 + x @ model.linear + np.array(pairs))


def test_gradient_learns_an_interaction():
    draw = np.random.default_rng(1)
    x = np.zeros((2000, 4))
    first, second = draw.integers(0, 2, 2000), draw.integers(0, 2, 2000)
    x[np.arange(2000), first] = 1
    x[np.arange(2000), 2 + second] = 1
    y = (first == second).astype(float)  # no linear model tells these apart
    assert ((fm.train(x, y).logits(x) > 0) == (y == 1)).mean() == 1


def test_held_out_accuracy(spark):
    rows = [(k, prose(k, 80) if k % 4 else junk(k // 4)) for k in range(240)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(k, int(bool(k % 4)), 0) for k in range(160)], "doc_id long, quality int, toxic int")
    machine = fm.fit(docs, labels)
    scored = {r.doc_id: r for r in fm.score(docs, machine).collect()}
    assert all(scored[k].predicted == bool(k % 4) for k in range(160, 240))
    kept = fm.keep_good(clashing(docs, "score", "c1"), machine)
    assert sorted(r[0] for r in kept.collect()) == [k for k in range(240) if k % 4]
    assert kept.columns == clashing(docs, "score", "c1").columns
    again = fm.fit(docs.repartition(5), labels.union(labels))
    assert again.bias == machine.bias and (again.factors == machine.factors).all()


def test_labels_with_nulls_repeats_and_no_text(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 0), (None, 0, 0), (3, 0, 0), (99, 0, 1), (4, 7, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, edge_rows())
    found = fm.score(clashing(docs, "predicted"), fm.fit(docs, labels)).collect()
    assert len(found) == len(edge_rows()) and all(0 <= r.score <= 1 for r in found)


def test_nothing_to_learn_from(spark):
    docs = documents(spark, edge_rows())
    none = fm.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.score for r in fm.score(docs, none).collect()} == {0.5}
    assert fm.score(documents(spark, []), none).collect() == []
    assert fm.keep_good(documents(spark, []), none).collect() == []


def test_sample_is_bounded(spark):
    docs = documents(spark, [(k, prose(k, 20)) for k in range(50)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(50)], "doc_id long, quality int, toxic int")
    assert (fm.fit(docs, labels, rows=3).factors != 0).any()


def test_repeated_ids_count_once_in_the_fit(spark, monkeypatch):
    sizes, train = [], fm.train
    monkeypatch.setattr(fm, "train", lambda x, y: sizes.append(len(y)) or train(x, y))
    rows = [(k, prose(k, 30) if k % 2 else junk(k)) for k in range(20)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    alone = fm.fit(documents(spark, rows), labels)
    copies = fm.fit(documents(spark, rows + [rows[3]] * 1500).repartition(7), labels)
    assert (copies.linear == alone.linear).all() and (copies.factors == alone.factors).all()
    other = rows + [(3, prose(100 + k, 30)) for k in range(900)] + [(5, None), (5, "")]
    first = fm.fit(documents(spark, other).repartition(7), labels)
    again = fm.fit(documents(spark, other[::-1]).coalesce(1), labels)
    assert (first.linear == again.linear).all() and (first.factors == again.factors).all()
    assert sizes == [20] * 4


def test_query_by_a_plain_scorer(spark, tmp_path):
    import math
    import zlib

    from martloom.llm import queries

    rows = [(k, prose(k, 60) if k % 4 else junk(k // 4)) for k in range(60)] + [(60, None), (61, ""), (61, ""), (None, "no key"), (62, prose(1, 20_000))]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(k, int(bool(k % 4)), 0) for k in range(50)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    model = queries.quality_machine(queries.table(spark, str(tmp_path), "labels"), queries.table(spark, str(tmp_path), "documents"))

    def plain(text):
        x = fm.features([text])[0].astype(float)
        seen = [i for i in range(len(x)) if x[i]]
        z = float(model.bias) + sum(x[i] * float(model.linear[i]) for i in seen)
        z += sum(x[i] * x[j] * sum(map(float, model.factors[i] * model.factors[j])) for i, j in itertools.combinations(seen, 2))
        return 1 / (1 + math.exp(-max(-30, min(30, z))))

    got = sorted(map(tuple, queries.QUERIES["op3_fm_quality"](spark, str(tmp_path)).collect()), key=str)
    wanted = sorted(((i, i is not None and zlib.crc32(str(i).encode()) % 3 == 1, plain(t)) for i, t in rows), key=str)
    assert [r[:2] for r in got] == [r[:2] for r in wanted]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in wanted], abs=2e-3)
    assert all(r[3] == (r[2] >= 0.5) for r in got)
