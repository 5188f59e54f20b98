import hashlib
import random
import re

import pytest

from martloom.llm import suffix_decontam as dec
from tests.llm.helpers import clashing, documents, edge_rows, prose


def plain_words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def plain_contamination(docs, items):
    out = []
    for i, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for item, t in items:
            test = plain_words(t)
            size = min(10, len(test))
            windows = {tuple(test[k : k + size]) for k in range(len(test) - size + 1)} if size else set()
            for at in range(len(words)):
                if size and tuple(words[at : at + size]) in windows:
                    hit.update(range(at, at + size))
                    found.add(str(item))
        out.append((i, len(words), len(hit), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return sorted(out, key=str)


def found_contamination(docs, bench):
    return sorted(((r.doc_id, r.n_words, r.n_hit, dec.digest(r["items"])) for r in dec.contamination(docs, bench).collect()), key=str)


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


ITEMS = [
    (1, prose(1, 30)), (2, prose(2, 12)), (3, "Short answer here"), (10, prose(1, 30)), (20, "one"), (21, None), (22, " ... "), (23, prose(4, 90)),
    (24, "aa aa aa aa aa aa aa aa aa aa aa aa aa"),
]


def cases():
    draw = random.Random(3)
    text = {i: t for i, t in ITEMS}
    rows = [(k, prose(100 + k, 60)) for k in range(20)]
    rows += [(100, prose(9, 40) + " " + text[1] + " " + prose(8, 40)), (101, text[2].upper().replace(" ", "-")), (102, "a SHORT, answer: here!")]
    rows += [(103, " ".join(text[1].split()[3:12])), (104, " ".join(text[1].split()[3:13])), (105, "x one y"), (106, "aa " * 25)]
    rows += [(107, text[23] + " " + text[23]), (108, text[23][:200]), (109, " ".join(draw.choice(ITEMS)[1] or "" for _ in range(9)))]
    return [*rows, (110, None), (110, None), (111, ""), (None, text[1])]


def test_by_brute_force(spark):
    docs = documents(spark, cases())
    assert found_contamination(docs, benchmark(spark, ITEMS)) == plain_contamination(cases(), ITEMS)
    assert found_contamination(docs.repartition(3), benchmark(spark, ITEMS)) == plain_contamination(cases(), ITEMS)


def test_small_shards_and_slices_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(dec, "SHARD_WORDS", 50)
    monkeypatch.setattr(dec, "STEP_ROWS", 2)
    wanted = plain_contamination(cases(), ITEMS)
    assert found_contamination(documents(spark, cases()), benchmark(spark, ITEMS)) == wanted
    slices = dec.test_sets
    monkeypatch.setattr(dec, "test_sets", lambda b, i, t: slices(b, i, t, slice_chars=100))
    assert len(list(dec.test_sets(benchmark(spark, ITEMS), "item_id", "text"))) > 5
    assert found_contamination(documents(spark, cases()), benchmark(spark, ITEMS)) == wanted
    kept = {r.doc_id for r in dec.drop_contaminated(documents(spark, cases()), benchmark(spark, ITEMS)).collect()}
    assert kept == {i for i, _, n, _ in wanted if not n}


def test_repeated_benchmark_rows_do_not_fill_a_slice(spark):
    bench = benchmark(spark, ITEMS + [ITEMS[0]] * 400).repartition(5)
    sets = list(dec.test_sets(bench, "item_id", "text", slice_chars=300))
    assert sorted(i for t in sets for i in t.items) == [i for i, t in ITEMS if plain_words(t)]
    assert len(sets) == len(list(dec.test_sets(benchmark(spark, ITEMS), "item_id", "text", slice_chars=300)))
    assert found_contamination(documents(spark, cases()), bench) == plain_contamination(cases(), ITEMS)


def plain_longest(docs, items):
    out = {}
    for item, text in items:
        test = plain_words(text)
        for at in range(len(test)):
            best = None
            for i, t in docs:
                words = plain_words(t)
                for k in range(len(words)):
                    size = 0
                    while at + size < len(test) and k + size < len(words) and test[at + size] == words[k + size]:
                        size += 1
                    best = max(best or (0, 0, 0), (size, -i, -k))
            if best and best[0] >= 3:
                out[item, at] = best[0]
    return out


def test_longest_matches(spark, monkeypatch):
    monkeypatch.setattr(dec, "DEPTH", 8)
    items = [(1, prose(1, 30)), (2, prose(2, 12)), (23, prose(4, 40))]
    docs = [(k, t) for k, t in cases() if t and k is not None and k != 4]
    got = dec.longest_matches(documents(spark, docs).repartition(3), benchmark(spark, items)).collect()
    assert {(r.item_id, r.item_word): r.words for r in got} == plain_longest(docs, items)
    text = dict(docs)
    for r in got:
        test, words = plain_words(dict(items)[r.item_id]), plain_words(text[r.doc_id])
        assert words[r.doc_word : r.doc_word + r.words] == test[r.item_word : r.item_word + r.words]


def plain_best(docs, items):
    """(words, place, item) of each document's longest match that starts with a window, by trying all places."""
    out = []
    for i, text in docs:
        words, best = plain_words(text), None
        for item, t in items:
            test = plain_words(t)
            size = min(10, len(test))
            for at in range(len(test) - size + 1 if test else 0):
                for k in range(len(words) - size + 1):
                    if words[k : k + size] == test[at : at + size]:
                        n = size
                        while at + n < len(test) and k + n < len(words) and words[k + n] == test[at + n]:
                            n += 1
                        told = (-n, k, item is None, item or 0)
                        best = min(best or told, told)
        out.append((i, *((-best[0], best[1], None if best[2] else best[3]) if best else (0, None, None))))
    return sorted(out, key=str)


@pytest.mark.parametrize(("depth", "slice_chars"), [(64, 10**6), (4, 10**6), (64, 100)])
def test_longest_match_of_each_document(spark, monkeypatch, depth, slice_chars):
    monkeypatch.setattr(dec, "DEPTH", depth)
    slices = dec.test_sets
    monkeypatch.setattr(dec, "test_sets", lambda b, i, t: slices(b, i, t, slice_chars=slice_chars))
    items = [*ITEMS, (30, prose(4, 90)), (None, prose(5, 20)), (5, " ".join(prose(4, 90).split()[:9])), (6, "aa aa aa")]
    docs = [*cases(), (300, prose(5, 20)), (301, "z " + prose(4, 60) + " z " + prose(4, 70)), (302, "aa aa aa aa b")]
    found = dec.contamination(documents(spark, docs), benchmark(spark, items)).collect()
    assert sorted(((r.doc_id, r.longest, r.longest_place, r.longest_item) for r in found), key=str) == plain_best(docs, items)


def test_slices_do_not_lengthen_the_plan(spark, monkeypatch):
    slices = dec.test_sets
    monkeypatch.setattr(dec, "test_sets", lambda b, i, t: slices(b, i, t, slice_chars=100))
    for made in (dec.contamination, dec.drop_contaminated):
        plan = made(documents(spark, cases()), benchmark(spark, ITEMS))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1


def test_query_and_its_sql(spark, tmp_path):
    import duckdb

    from martloom.llm import queries

    documents(spark, [*cases(), *cases()[20:24]]).write.parquet(f"{tmp_path}/documents.parquet")
    benchmark(spark, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("documents", "benchmark"):
        duckdb.sql(f"create or replace view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = queries.QUERIES["op4_suffix_decontam"](spark, str(tmp_path))
    sql = duckdb.sql(queries.ORACLES["op4_suffix_decontam"])
    assert got.columns == sql.columns and sorted(map(tuple, got.collect()), key=str) == sorted(sql.fetchall(), key=str)


def test_spans_and_clashing_columns(spark):
    docs = clashing(documents(spark, cases()), "items", "spans", "n_words")
    found = {r.doc_id: r for r in dec.contamination(docs, clashing(benchmark(spark, ITEMS[:1]), "doc_id")).collect()}
    assert found[100].spans == [[40, 70]] and found[103].spans == [] and found[104].spans == [[0, 10]]
    kept = dec.drop_contaminated(docs, benchmark(spark, ITEMS))
    assert kept.columns == docs.columns and {r[0] for r in kept.collect()} == {i for i, _, n, _ in plain_contamination(cases(), ITEMS) if not n}


def test_empty_tables_and_edges(spark):
    none = benchmark(spark, [])
    assert {r.n_hit for r in dec.contamination(documents(spark, cases()), none).collect()} == {0}
    assert dec.drop_contaminated(documents(spark, cases()), none).count() == len(cases())
    assert dec.contamination(documents(spark, []), benchmark(spark, ITEMS)).collect() == []
    assert dec.longest_matches(documents(spark, cases()), none).collect() == []
    rows = [(i, t) for i, t, _ in edge_rows()]
    assert found_contamination(documents(spark, rows), benchmark(spark, [(1, "wörter wörter"), (None, "0 1 2")])) == plain_contamination(
        rows, [(1, "wörter wörter"), (None, "0 1 2")]
    )


@pytest.mark.parametrize("text", [None, "", "A-b_c9é", "x\x7fy\x80z", "ÄB"])
def test_words(text):
    assert [w.decode() for w in dec.words_of(text)] == plain_words(text)
