from martloom.llm import preference as pref
from tests.llm.helpers import clashing


def pairs(spark, rows):
    return spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string")


def both(pair, chosen, rejected):
    return [(pair, s, k, r, t) for s, turns in (("chosen", chosen), ("rejected", rejected)) for k, (r, t) in enumerate(turns)]


def plain_example(chosen, rejected):
    """Prompt, completions and masks, turn by turn."""
    same = 0
    while same < min(len(chosen), len(rejected)) and chosen[same] == rejected[same]:
        same += 1
    show = lambda r, t: (f"<|im_start|>{r or ''}\n", f"{t or ''}<|im_end|>\n")
    out = ["".join(sum((show(*x) for x in chosen[:same]), ()))]
    masks = []
    for turns in (chosen[same:], rejected[same:]):
        text, spans = "", []
        for r, t in turns:
            header, body = show(r, t)
            if r == "assistant":
                spans.append([len(text) + len(header), len(text) + len(header) + len(body)])
            text += header + body
        out.append(text)
        masks.append(spans)
    return (*out, *masks)


CASES = {
    1: ([("user", "q"), ("assistant", "good")], [("user", "q"), ("assistant", "bad")]),
    2: ([("system", "s"), ("user", "é梦"), ("assistant", "a"), ("user", "b"), ("assistant", "c")], [("system", "s"), ("user", "é梦"), ("assistant", "x")]),
    3: ([("user", "q")], [("user", "other")]),
    4: ([("user", "q"), ("assistant", "a")], [("user", "q")]),
    5: ([("user", "q"), ("assistant", "a")], [("user", "q"), ("assistant", "a")]),
    6: ([("user", None), ("assistant", None)], [("user", None), (None, None), ("assistant", "")]),
    7: ([("user", "same"), ("user", "q")], [("user", "same"), ("assistant", "q"), ("assistant", "w" * 5000)]),
}


def test_prompt_completions_and_masks(spark):
    df = pairs(spark, [r for k, (c, j) in CASES.items() for r in both(k, c, j)])
    got = pref.examples(pref.segments(clashing(df, "part", "loss", "end")))
    assert {r.pair_id: tuple(r)[1:] for r in got.collect()} == {k: (0, *plain_example(c, j)) for k, (c, j) in CASES.items()}


def test_segments_mask_only_replies_of_completions(spark):
    found = pref.segments(pairs(spark, both(2, *CASES[2]))).collect()
    assert {(r.part, r.turn): r.loss for r in found} == {
        ("prompt", 0): False, ("prompt", 1): False, ("chosen", 2): True, ("rejected", 2): True, ("chosen", 3): False, ("chosen", 4): True,
    }


def test_repeated_and_numberless_turns(spark):
    rows = both(1, *CASES[1])
    df = pairs(spark, [*rows, *rows, (None, "chosen", 0, "user", "x"), (1, "else", 0, "user", "x")])
    assert tuple(pref.examples(pref.segments(df.where("pair_id is not null"))).first())[2:] == plain_example(*CASES[1])
    turns = spark.createDataFrame(
        [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", "z"), (None, 0, "user", "z")],
        "conv_id long, turn long, role string, text string",
    )
    got = pref.examples(pref.segments(pref.forked_pairs(turns))).collect()
    assert sorted(map(tuple, got)) == [(0, 0, *plain_example([], [("user", "a")])), (1, 0, *plain_example([("user", "a")], []))]


TALK = {
    0: [("user", "q"), ("assistant", "r0"), ("user", "later")],
    1: [("user", "q"), ("assistant", "r1"), ("user", "more"), ("assistant", "end")],
    2: [("user", "two"), ("assistant", "a2"), ("user", "b2")],
    3: [("user", "three"), ("assistant", "a3")],
    4: [("user", "alone"), ("user", "x" * 30_000), ("assistant", "a")],
    6: [("system", "s"), ("user", "x" * 30_000), ("assistant", "a"), ("assistant", "tail")],
    7: [("system", "s"), ("user", "x" * 30_000), (None, None)],
    14: [("assistant", "other"), (None, None)],
    -2: [("user", "below")],
    -1: [("user", "zero")],
}


def plain_pairs():
    out = {}
    for c in {*TALK, *(c ^ 1 for c in TALK)}:
        own, fork = TALK.get(c, []), (c // 2) % pref.FORKS
        rejected = own[:fork] + TALK.get(c ^ 1, [])[fork:]
        if own or rejected:
            out[c] = plain_example(own, rejected)
    return out


def talk(spark):
    rows = [(c, k, r, t) for c, turns in TALK.items() for k, (r, t) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_whole_conversations_fork_into_their_neighbours(spark):
    got = pref.examples(pref.segments(pref.forked_pairs(clashing(talk(spark), "side", "pair_id", "piece")))).collect()
    assert {r.pair_id: tuple(r)[2:] for r in got} == plain_pairs()
    assert len({len(p) for p, *_ in plain_pairs().values()}) > 3


def test_long_conversations_go_on_in_further_rows(spark):
    rendered = pref.segments(pref.forked_pairs(talk(spark)))
    whole = {r.pair_id: r for r in pref.examples(rendered).collect()}
    cut = pref.examples(rendered, row_turns=2).orderBy("pair_id", "piece").collect()
    assert max(r.piece for r in cut) == 1
    for k, r in whole.items():
        pieces = [x for x in cut if x.pair_id == k]
        for name in ("prompt", "chosen", "rejected"):
            assert "".join(x[name] for x in pieces) == r[name]
        for name in ("chosen", "rejected"):
            learned = lambda x: [x[name][a:b] for a, b in x[name + "_mask"]]  # noqa: B023, E731
            assert sum(map(learned, pieces), []) == learned(r)


def test_query_and_its_sql(spark, tmp_path):
    import duckdb

    from martloom.llm import queries

    talk(spark).unionByName(talk(spark)).write.parquet(str(tmp_path / "conversations.parquet"))
    duckdb.sql(f"create or replace view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = queries.QUERIES["op6_preference"](spark, str(tmp_path))
    sql = duckdb.sql(queries.ORACLES["op6_preference"])
    assert got.columns == sql.columns
    assert sorted(map(tuple, got.collect())) == sorted(sql.fetchall()) and len(got.collect()) == len(plain_pairs())


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert pref.examples(pref.segments(pref.forked_pairs(none))).collect() == []
