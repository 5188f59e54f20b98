"""Language identification: every document as a mixture of languages.

Letter trigrams of the documents whose language is known give a distribution for each language, over
all such documents. For a document, expectation-maximisation estimates the languages' proportions; the
set of languages is then chosen by its likelihood less a penalty for each language more. Texts
that are null or have no letter are ``und`` with score 0, and so is every text if nothing was learned.
Equal proportions go by the language's name. A text is held whole, however long, with its trigrams' numbers.
Repeated rows are judged one by one, an empty table gives an empty result, other columns are ignored.

The filter adds a component for all else to the mixture: letters drawn one by one, half by their shares in the
languages and half at random. What it takes is in no known language, be it a language that was never learned or noise.
A trigram that a language lacks tells the more, the more was learned: below some 100,000 trigrams a language, texts in
other scripts stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from martloom.llm.rows import filter_rows, map_batches, pick

UNKNOWN = "und"
CLASS_BITS = 6
GRAMS = 1 << (3 * CLASS_BITS)
SMOOTHING = 0.2
ROUNDS = 15
SETTLED = 1e-3
# Least share of a language to be tried as a further member of the set.
LEAST_SHARE = 0.02
# Of the set's penalty: so many times half the logarithm of the document's trigrams, per language more.
PENALTY = 6.0
# Documents of which all known languages together explain less than this share are rejected by the filter; mixtures of known languages stay.
REJECT_BELOW = 0.5
# Languages a task counts at a time.
HELD_LANGUAGES = 32


def has_letter(text: str | None) -> bool:
    """Numbers, signs and marks alone, of any script, are no letters."""
    return any(map(str.isalpha, text or ""))


def byte_classes() -> bytes:
    """Letters keep their own class; other bytes of UTF-8 share a few; all else is a gap (0)."""
    table = bytearray(256)
    for k in range(26):
        table[ord("a") + k] = table[ord("A") + k] = 1 + k
    for b in range(0x80, 0xC0):
        table[b] = 27 + b % 21
    for b in range(0xC0, 0x100):
        table[b] = 48 + b % 16
    return bytes(table)


CLASSES = byte_classes()


def grams(text: str) -> np.ndarray:
    """Codes of the trigrams around each letter, gaps of any length being one."""
    kinds = np.frombuffer((" " + text.lower() + " ").encode().translate(CLASSES), np.uint8)
    gap = kinds == 0
    kinds = kinds[~(gap & np.concatenate([[False], gap[:-1]]))].astype(np.int32)
    codes = (kinds[:-2] << (2 * CLASS_BITS)) | (kinds[1:-1] << CLASS_BITS) | kinds[2:]
    return codes[kinds[1:-1] > 0]


@dataclass(frozen=True)
class Languages:
    """Names, each language's trigram probabilities (trigram by language), and those of anything else."""

    names: list[str]
    chances: np.ndarray
    other: np.ndarray

    def mixture(self, text: str | None) -> tuple[list[str], list[float], float]:
        """Languages of the chosen set by falling proportion, their proportions, and the first one's share among all languages."""
        if not self.names or not has_letter(text):
            return [], [], 0.0
        found, counts = np.unique(grams(text), return_counts=True)
        chances, counts = self.chances[found], counts.astype(np.float32)
        total = counts.sum()
        shares, _ = maximise(chances, counts, total, np.full(len(self.names), 1 / len(self.names), np.float32), ROUNDS)
        order = np.argsort(-shares, kind="stable")
        alone = counts @ np.log(chances)
        best = int(np.argmax(alone))
        members, weights, value = [best], np.ones(1), float(alone[best])
        cost = PENALTY * 0.5 * np.log(max(2.0, float(total)))
        for k in range(2, len(order) + 1):
            if shares[order[k - 1]] < LEAST_SHARE:
                break
            some = order[:k]
            tried, likely = maximise(chances[:, some], counts, total, shares[some] / shares[some].sum(), ROUNDS)
            if likely - cost * (k - 1) > value:
                value = likely - cost * (k - 1)
                members, weights = some.tolist(), tried
        ranked = sorted(range(len(members)), key=lambda i: (-weights[i], self.names[members[i]]))
        names = [self.names[members[i]] for i in ranked]
        return names, [float(weights[i]) for i in ranked], float(min(1, max(0, shares[members[ranked[0]]])))

    def known_share(self, text: str | None) -> float:
        """Share of all languages together, beside the component for anything else; 0 without a letter or a language."""
        if not self.names or not has_letter(text):
            return 0.0
        found, counts = np.unique(grams(text), return_counts=True)
        chances, counts = np.column_stack([self.chances[found], self.other[found]]), counts.astype(np.float32)
        size = chances.shape[1]
        shares, _ = maximise(chances, counts, counts.sum(), np.full(size, 1 / size, np.float32), ROUNDS)
        return float(min(1, max(0, shares[:-1].sum())))

    def predict(self, text: str | None) -> tuple[str, float]:
        names, _, score = self.mixture(text)
        return (names[0], score) if names else (UNKNOWN, 0.0)


def maximise(chances: np.ndarray, counts: np.ndarray, total: float, shares: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Proportions by expectation-maximisation, and the log likelihood."""
    for _ in range(rounds):
        mixed = chances @ shares
        new = shares * ((counts / mixed) @ chances) / total
        change = np.abs(new - shares).max()
        shares = new
        if change < SETTLED:
            break
    return shares, float(counts @ np.log(chances @ shares))


def background(counts: np.ndarray) -> np.ndarray:
    """Trigrams of letters drawn one by one: half by their shares, each language weighing the same, half at random."""
    totals = counts.sum(axis=0)
    kinds = 1 << CLASS_BITS
    shares = (counts[:, totals > 0] / totals[totals > 0]).sum(axis=1).reshape(kinds, kinds, kinds) / max(1, (totals > 0).sum())
    first, middle, last = shares.sum(axis=(1, 2)), shares.sum(axis=(0, 2)), shares.sum(axis=(0, 1))
    drawn = first[:, None, None] * middle[:, None] * last
    return (0.5 * drawn.reshape(-1) + 0.5 / (kinds * (kinds - 1) * kinds)).astype(np.float32)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Languages:
    """Trigram counts over all documents with a language; a row per language and seen trigram comes to the driver."""
    known = pick(docs, text, lang).where(F.col(lang).isNotNull() & F.col(text).isNotNull())

    def work(steps):
        held: dict[str, np.ndarray] = {}

        def told():
            rows = [[], [], []]
            for k, counts in held.items():
                seen = np.flatnonzero(counts)
                rows[0] += [k] * len(seen)
                rows[1] += seen.tolist()
                rows[2] += counts[seen].tolist()
            held.clear()
            return rows

        for texts, langs in steps:
            by: dict[str, list[np.ndarray]] = {}
            for value, k in zip(texts, langs, strict=True):
                by.setdefault(k, []).append(grams(value))
            for k, found in by.items():
                if k not in held and len(held) >= HELD_LANGUAGES:
                    yield told()
                held[k] = held.get(k, 0) + np.bincount(np.concatenate(found), minlength=GRAMS)
        yield told()

    counted = map_batches(known, "lang string, gram int, n long", work).groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    names = sorted({r["lang"] for r in counted})
    counts = np.zeros((GRAMS, len(names)))
    at = {k: i for i, k in enumerate(names)}
    for r in counted:
        counts[r["gram"], at[r["lang"]]] = r["n"]
    size = max(1, int((counts.sum(axis=1) > 0).sum()))
    chances = (counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * size)
    return Languages(names, chances.astype(np.float32), background(counts))


def identify(docs: DataFrame, languages: Languages, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, languages, proportions) of every row."""
    rows = pick(docs, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(languages)  # languages x trigrams, whatever the number of documents

    def work(steps):
        model = shared.value
        for keys, texts in steps:
            mixed = [model.mixture(t) for t in texts]
            said = [(m[0][0], m[2]) if m[0] else (UNKNOWN, 0.0) for m in mixed]
            yield [keys, [s[0] for s in said], [s[1] for s in said], [m[0] for m in mixed], [m[1] for m in mixed]]

    schema = f"{key} {dict(rows.dtypes)[key]}, lang_pred string, score double, languages array<string>, proportions array<double>"
    return map_batches(rows, schema, work)


def keep_identified(docs: DataFrame, languages: Languages, text: str = "text", below: float = REJECT_BELOW) -> DataFrame:
    """Documents of which the known languages together have a share of ``below`` or more; ``und`` goes."""
    shared = docs.sparkSession.sparkContext.broadcast(languages)

    def judge():
        model = shared.value

        def accept(texts):
            return [has_letter(t) and model.known_share(t) >= below for t in texts]

        return accept

    return filter_rows(docs, text, judge)
