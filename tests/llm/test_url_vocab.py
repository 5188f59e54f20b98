import re

import pytest

from martloom.llm import url_vocab as uv
from tests.llm.helpers import clashing

URLS = [
    None, "", "no scheme", "http://", "http://Host.ORG", "http://a.org/", "https://example.org/es/x", "https://m.example.org/es", "x://example.org/en/1?q",
    "http://example.org/en/2", "http://a.com/fr/1", "http://a.com/de/1#f", "http://com/de/", "http://xcom/de/", "http://a.com?x=/de/", "http://casino.net/",
    "http://casinos.net/", "http://my-casino.net/", "http://a.net/free/win", "http://a.net/free/free", "http://a.net/FREE?Win=1", "http://spam.org/", "http://a.net/freewin",
    "http://é.net/porn", "http://a.net:80/xxx", "a://b://c.org/", "http://a.net/" + "free-" * 5000 + "z",
]


def plain(url):
    host = path = ""
    if url and (m := re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url)):
        host, path = re.sub("[A-Z]", lambda x: x[0].lower(), m[2]), m[3]
    best = None
    for verdict, rule in uv.RULES:
        at, _, start = rule.partition("/")
        if ("." + host).endswith("." + at) and path.startswith("/" + start) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    if best:
        return host, path, *best
    text = re.sub("[A-Z]", lambda x: x[0].lower(), url or "")
    has = lambda w: re.search(f"(?<![a-z0-9]){w}(?![a-z0-9])", text)
    bad = any(map(has, uv.STRICT)) or sum(bool(has(w)) for w in uv.SOFT) >= uv.SOFT_LIMIT
    return host, path, None, "block" if bad else "allow"


@pytest.mark.parametrize("url", URLS)
def test_by_plain_rules(url):
    assert uv.Judge()(url)[:4] == plain(url)


def test_counts_and_boundaries():
    judge = uv.Judge()
    assert judge.hits("http://spam.spam/spamx?free&free") == (2, 1)
    assert judge.hits("xspam spam9 free") == (0, 1)
    assert uv.Judge(uv.Filter(rules=(), strict=(), soft=("a-b", "b"), soft_limit=2))("http://a-b/")[3:] == ("block", 0, 2)
    assert uv.Judge(uv.Filter(rules=(), strict=(), soft=()))("http://casino/")[3] == "allow"


def test_table(spark):
    pages = spark.createDataFrame([*enumerate(URLS), (0, None), (None, "http://a.org/")], "page_id long, url string")
    got = uv.judge(clashing(pages, "host", "verdict")).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(((k, *plain(u)) for k, u in [*enumerate(URLS), (0, None), (None, "http://a.org/")]), key=str)
    assert uv.judge(pages.limit(0)).collect() == []


def test_terms_in_upper_case_match_the_folded_text():
    judge = uv.Judge(uv.Filter(strict=("Casino",), soft=("WIN", "free")))
    assert judge("http://a.net/CASINO")[3:] == ("block", 1, 0)
    assert judge("http://a.net/win/Free")[3:] == ("block" if judge.limit <= 2 else "allow", 0, 2)
