import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from martloom.llm import sp_prefix as sp
from martloom.llm.queries import tokenizer_path
from tests.llm.helpers import clashing, documents, edge_rows, prose

MODEL = sp.read_model(tokenizer_path())
OWN = sp.encoder(MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def ids(text):
    return np.frombuffer(OWN.encode(text), "<u4").tolist()


def plain(text):
    return [LIBRARY.bos_id(), *LIBRARY.encode(text or ""), LIBRARY.eos_id()]


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert ids(text) == plain(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(sorted(OWN.number)), max_size=8))
def test_pieces_in_any_order(pieces):
    assert ids("".join(pieces)) == plain("".join(pieces))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" ▁\n\tathe.,é梦☃\x00", max_size=80))
def test_marks_and_unknown_characters(text):
    assert ids(text) == plain(text)


@pytest.mark.parametrize("part", [" ", "a", "ab", "the", "=", "-", "1", "\n", ".", "▁"])
def test_runs(part):
    for n in (*range(40), 500):
        assert ids(part * n) == plain(part * n)
        assert ids(part * n + "x") == plain(part * n + "x")


def test_each_prefix_has_its_own_last_token():
    draw = random.Random(0)
    for _ in range(300):
        part = "▁" + "".join(draw.choice("thering.,s") for _ in range(draw.randrange(1, 14)))
        assert [OWN.piece[t] for t in OWN.table(part)] == [OWN.merged(part[: k + 1])[-1] for k in range(len(part))]


def test_remembered_parts_change_nothing(monkeypatch):
    monkeypatch.setattr(sp, "HELD_PARTS", 3)
    monkeypatch.setattr(sp, "HELD_PAIRS", 5)
    own = sp.Encoder(MODEL)
    for k in range(30):
        text = prose(k, 50)
        assert np.frombuffer(own.encode(text), "<u4").tolist() == plain(text)


def test_round_trip_and_digests(spark):
    rows = [*edge_rows(), (8, "a  b\n\n c ", None), (9, "x" * 20_000, None)]
    docs = clashing(documents(spark, rows), "ids", "n_tokens")
    tokens = sp.encode(docs, MODEL)
    assert sorted(((r.doc_id, r.ids) for r in tokens.collect()), key=str) == sorted(((i, plain(t)) for i, t, _ in rows), key=str)
    said = sorted(((r.doc_id, r.text) for r in sp.decode(tokens, MODEL).collect()), key=str)
    assert said == sorted(((i, LIBRARY.decode(plain(t))) for i, t, _ in rows), key=str)
    import hashlib

    found = {r.doc_id: r for r in sp.digests(docs, MODEL).collect()}
    wanted = plain("a  b\n\n c ")
    assert found[8].n_tokens == len(wanted)
    assert found[8].ids_sha256 == hashlib.sha256(np.array(wanted, dtype="<u4").tobytes()).hexdigest()
    assert found[8].decoded_sha256 == hashlib.sha256(LIBRARY.decode(wanted).encode()).hexdigest()
    assert sp.digests(documents(spark, []), MODEL).collect() == []


def test_null_ids(spark):
    assert sp.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<long>"), MODEL).first().text is None
