import hashlib
import math
import random

import numpy as np
import pytest

from martloom.llm import vector_codes as vc
from martloom.llm.queries import vector_code
from tests.llm.helpers import clashing

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, settings):
    """(vec_id, code, error, label_error) of the rows that are kept, and the codebooks, with plain integers."""
    fine = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) and abs(x * settings.scale) < vc.LARGEST for x in r[1])]
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, [float(np.float32(x)) for x in r[1]]))
    fine = [r for r in fine if len(r[1]) == len(fine[0][1])] if fine else []
    if not fine:
        return [], None
    length = len(fine[0][1])
    width = -(-length // settings.parts)
    ints = [[math.floor(settings.scale * float(np.float32(x))) for x in r[1]] + [0] * (width * settings.parts - length) for r in fine]
    cut = [[v[p * width : (p + 1) * width] for p in range(settings.parts)] for v in ints]
    books = [[c[p] for c in cut[: settings.entries]] for p in range(settings.parts)]

    def nearest(part, p):
        far = [sum((x - y) ** 2 for x, y in zip(part, e)) for e in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(settings.rounds):
        chosen = [[nearest(c[p], p)[0] for p in range(settings.parts)] for c in cut]
        for p in range(settings.parts):
            for e in range(len(books[p])):
                own = [c[p] for c, k in zip(cut, chosen) if k[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    out, by_label = [], {}
    for r, c in zip(fine, cut):
        found = [nearest(c[p], p) for p in range(settings.parts)]
        error = sum(f for _, f in found)
        out.append((r[0], "".join(f"{k:02x}" for k, _ in found), error, r[2]))
        by_label[r[2]] = by_label.get(r[2], 0) + error
    return [(k, code, error, by_label[label]) for k, code, error, label in out], books


def drawn(count, length, seed=1):
    draw = random.Random(seed)
    return [(i, [draw.gauss(0, 0.2) for _ in range(length)], draw.choice([None, 0, 1, 2])) for i in range(count)]


def check(spark, rows, settings=None, partitions=3):
    settings = settings or vc.Settings()
    table = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    coded, coding = vc.compress(table, settings)
    expected, books = plain(rows, settings)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in coded.collect()), key=repr) == sorted(expected, key=repr)
    if books:
        text = ",".join(str(x) for part in books for entry in part for x in entry)
        assert coding.digest() == hashlib.sha256(text.encode()).hexdigest()
    else:
        assert coding is None


def test_by_plain_integers(spark):
    check(spark, drawn(300, 32))


def test_fewer_rows_than_entries_and_uneven_length(spark):
    check(spark, drawn(40, 20))
    check(spark, drawn(7, 3), vc.Settings(parts=2, entries=4, rounds=3))


def test_dropped_rows_and_ties(spark):
    rows = drawn(120, 16)
    rows += [(200, None, 1), (201, [], 1), (202, [None] + [0.1] * 15, 1), (203, [math.nan] + [0.1] * 15, 1), (-5, [math.inf] * 16, 1)]
    rows += [(204, [1e30] * 16, 1), (205, [0.1] * 32, 1), (None, [0.3] * 16, None), (None, None, None)]
    rows += [(3, rows[7][1], 2), (3, rows[3][1], 2)] + [rows[5]] * 4
    check(spark, rows)


def test_the_smallest_id_decides_the_length(spark):
    check(spark, [(-1, [0.5] * 32, 0)] + drawn(80, 16) + [(500, [-0.25] * 32, None)])


def test_one_vector_holds_a_third(spark):
    rows = drawn(200, 16)
    check(spark, [(i, rows[0][1], 7) if i % 3 == 0 else r for i, r in enumerate(rows)], partitions=7)


def test_no_rows(spark):
    check(spark, [])
    check(spark, [(1, None, 0)])


def test_other_columns(spark):
    rows = drawn(90, 16)
    table = clashing(spark.createDataFrame(rows, SCHEMA), "code", "error", "label_key", "vector", "ids")
    got = vc.compress(table)[0].select("vec_id", "code", "error", "label_error").collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows, vc.Settings())[0])


def test_blocks_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(vc, "BLOCK_VALUES", 64)
    check(spark, drawn(100, 16))


def test_dictionary_holds_the_vectors():
    numbers = np.random.default_rng(1).integers(-9, 9, (50, 6))
    sizes, values, places = vc.dictionary(numbers)
    block = vc.Block.read(sizes.tobytes(), values.tobytes(), places.tobytes())
    assert all((v[p] == numbers[:, d]).all() for d, (v, p) in enumerate(zip(block.values, block.places)))


@pytest.mark.parametrize("scale", [1, 256])
def test_decoding_is_as_far_as_the_error(spark, scale):
    settings = vc.Settings(scale=scale)
    rows = drawn(100, 20)
    coded, coding = vc.compress(spark.createDataFrame(rows, SCHEMA), settings)
    for r in coded.collect():
        vector = vc.whole(np.array([rows[r["vec_id"]][1]], dtype=np.float32).astype(float), settings)[0]
        far = sum((int(x) - y) ** 2 for x, y in zip(vector, vc.decode(r["code"], coding)))
        assert far <= r["error"] and len(vc.decode(r["code"], coding)) == 20


def test_query_without_rows(spark, folder):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/embeddings.parquet")
    assert vector_code(spark, folder).collect() == []
