"""URL filters: rules by host and path, then a weighted vocabulary counted by an automaton.

Rules allow or block a host with its subdomains, from a path on; the longest that fits decides. Where none
fits, terms are counted in the URL: a term counts where no ASCII letter or digit stands before or after it.
One strict term, or ``SOFT_LIMIT`` different soft ones, block. A null URL, or one without ``://``, has
an empty host and path, fits no rule, and is judged by its terms alone (null: allowed). Of
equally long rules the first decides; terms are folded as the URL is. A URL is read once, however long. Repeated
rows are judged one by one, an empty table gives an empty result, and other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
from pyspark.sql import DataFrame

from martloom.llm.rows import map_batches, pick

ALLOW, BLOCK = "allow", "block"

# Rules and terms.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
STRICT = ("spam", "porn", "porno", "xxx", "casino", "viagra", "escort", "warez", "phishing", "malware")
SOFT = (
    "adult", "ads", "betting", "bonus", "cheap", "click", "coupon", "dating", "deal", "download", "free", "gambling", "loan",
    "lottery", "payday", "pills", "poker", "prize", "promo", "sex", "torrent", "win", "winner",
)
SOFT_LIMIT = 2
_INSIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


@dataclass(frozen=True)
class Filter:
    """Rules, strict and soft terms, and the number of different soft terms that block."""

    rules: tuple[tuple[str, str], ...] = RULES
    strict: tuple[str, ...] = STRICT
    soft: tuple[str, ...] = SOFT
    soft_limit: int = SOFT_LIMIT


def split_url(url: str | None) -> tuple[str, str]:
    """Host, with A-Z lower-cased, and path; both as they stand in the URL."""
    before, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    ends = [k for c in "/?#" if (k := rest.find(c)) >= 0]
    cut = min(ends, default=len(rest))
    path = rest[cut:]
    ends = [k for c in "?#" if (k := path.find(c)) >= 0]
    return lower(rest[:cut]), path[: min(ends, default=len(path))]


def lower(text: str) -> str:
    """A-Z only."""
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


class Judge:
    def __init__(self, known: Filter = Filter()):
        self.limit = known.soft_limit
        # the longest rule that fits wins; of equals the first
        self.rules = sorted(((r, *split_rule(r), verdict) for verdict, r in known.rules), key=lambda x: -len(x[0]))
        self.terms = ahocorasick.Automaton()
        for weight, words in ((0, known.soft), (1, known.strict)):
            for w in map(lower, words):  # as the text is
                self.terms.add_word(w, (w, weight))
        if len(self.terms):
            self.terms.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str | None, str | None]:
        for name, at, start, verdict in self.rules:
            if (host == at or host.endswith("." + at)) and path.startswith(start):
                return name, verdict
        return None, None

    def hits(self, url: str | None) -> tuple[int, int]:
        """Occurrences of strict terms, and how many different soft terms occur."""
        text = lower(url or "")
        strict, soft = 0, set()
        for end, (word, weight) in self.terms.iter(text) if text and len(self.terms) else ():
            start = end - len(word)
            if (start >= 0 and text[start] in _INSIDE) or (end + 1 < len(text) and text[end + 1] in _INSIDE):
                continue
            if weight:
                strict += 1
            else:
                soft.add(word)
        return strict, len(soft)

    def __call__(self, url: str | None) -> tuple[str, str, str | None, str, int, int]:
        """Host, path, rule, verdict, strict hits, different soft hits."""
        host, path = split_url(url)
        name, verdict = self.rule(host, path)
        strict, soft = self.hits(url)
        return host, path, name, verdict or (BLOCK if strict or soft >= self.limit else ALLOW), strict, soft


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", known: Filter = Filter()) -> DataFrame:
    """(key, host, path, rule, verdict, strict_hits, soft_hits) of every row."""
    rows = pick(pages, key, url)

    def work(steps):
        verdict = Judge(known)
        for keys, urls in steps:
            yield [keys, *(list(c) for c in zip(*map(verdict, urls), strict=True))] if keys else [[]] * 7

    schema = f"{key} {dict(rows.dtypes)[key]}, host string, path string, rule string, verdict string, strict_hits long, soft_hits long"
    return map_batches(rows, schema, work)
