"""The stages and the whole pipeline against plain versions of them."""

import hashlib
import os

import numpy as np
import pytest

import corpus_pipeline as pipeline
from martloom.llm import queries as corpus, sp_prefix as sp
from tests.llm.helpers import GERMAN, clashing, documents, prose
from tests.llm.test_fm_quality import junk
from tests.llm.test_simhash_trie import plain_components
from tests.llm.test_suffix_decontam import plain_contamination


def rows():
    out = [(k, prose(k, 90), "en") for k in range(60)] + [(100 + k, prose(k, 90, GERMAN), "de") for k in range(60)]
    out += [(200 + k, junk(k), "en") for k in range(40)]
    out += [(300 + k, prose(3, 90), "en") for k in range(5)] + [(310, prose(4, 90) + " end", "en"), (320, prose(7, 40) + " " + prose(900, 20) + " " + prose(8, 40), "en")]
    return [*out, (3, prose(3, 90), "en"), (400, None, None), (401, "", "en"), (402, "123 456", None)]


@pytest.fixture
def tables(spark, tmp_path):
    folder = str(tmp_path / "sf")
    documents(spark, rows()).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, 1, 0) for k in [*range(60), *range(100, 160)]] + [(200 + k, 0, 0) for k in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, prose(900, 20))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_by_hand(spark, tables):
    docs = clashing(documents(spark, rows()), "score", "fp")
    steps = [f for _, f in pipeline.STAGES]
    good = steps[0](spark, docs, tables)
    ids = lambda df: sorted(r[0] for r in df.collect())
    clean = [i for i, *_ in rows() if i < 200 or 300 <= i < 400]
    assert [i for i in ids(good) if i < 400] == sorted(clean)
    named = steps[1](spark, good, tables)
    assert ids(named) == sorted(clean)
    alone = steps[2](spark, named, tables)
    kept = [(i, t) for i, t, _ in rows() if i in set(clean)]
    groups = {}
    for i, _, c in plain_components(kept):
        groups.setdefault(c, []).append(i)
    assert ids(alone) == sorted(min(g) for g in groups.values()) and 300 not in ids(alone) and 3 in ids(alone)
    free = steps[3](spark, alone, tables)
    hit = {i for i, _, n, _ in plain_contamination(kept, [(1, prose(900, 20))]) if n}
    assert hit == {320} and ids(free) == [i for i in ids(alone) if i not in hit]
    assert good.columns == named.columns == alone.columns == free.columns == docs.columns


def test_whole_pipeline(spark, tables):
    found = pipeline.run(spark, tables).collect()
    text = {i: t for i, t, _ in rows()}
    library = sp.encoder(sp.read_model(corpus.tokenizer_path())).library
    assert 3 in {r.doc_id for r in found} and not {r.doc_id for r in found} & {300, 301, 320, 400, *range(200, 240)}
    for r in found:
        ids = [1, *library.encode(text[r.doc_id]), 2]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())


def test_empty_and_all_null_tables(spark, tmp_path):
    for k, data in enumerate(([], [(None, None), (1, None), (1, None), (2, "")])):
        folder = str(tmp_path / str(k))
        documents(spark, data).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        found = pipeline.run(spark, folder)
        # nothing is learned, so nothing is rejected; the texts without words are one group
        assert found.count() == (1 if data else 0)


def test_every_dealt_query_is_registered():
    import __spark_entry__ as registered

    names = registered.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert os.path.exists(corpus.tokenizer_path())
