"""SentencePiece encoding of merge-type models by a table of last tokens, and decoding.

Text is normalised by the model's own rules and cut where no piece reaches across (before word marks, at
characters that no piece has). For each prefix of a part, the table holds the one last token
that its encoding ends with: an automaton gives the pieces that end there, and that one is taken which may
follow the last token of the prefix before it, i.e. whose pair the merge rules leave as it is. The ids
are recovered backwards from the table. A null or empty text has only the begin and end ids and decodes
to an empty text. Equal merges go by their place, as in the library. A text is held whole, however long, with one token per prefix of a part. Repeated rows are encoded one by one, an empty table gives an empty result, and
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import sentencepiece
from pyspark.sql import DataFrame

from martloom.llm.rows import map_batches, pick

MARK = "▁"
# Parts whose ids a worker remembers, and the longest of them.
HELD_PARTS = 300_000
HELD_CHARS = 48
HELD_PAIRS = 2_000_000


class Encoder:
    """Encodes and decodes with one model; ``model`` is the content of its file."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        lib = self.library
        every = range(lib.get_piece_size())
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        self.bytes = {lib.id_to_piece(i): i for i in every if lib.is_byte(i)}
        self.byte_ids = [self.bytes.get(f"<0x{b:02X}>", lib.unk_id()) for b in range(256)]
        self.has_bytes = len(self.bytes) == 256
        self.unknown = lib.unk_id()
        plain = [i for i in every if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.piece = {i: lib.id_to_piece(i) for i in plain}
        self.number = {p: i for i, p in self.piece.items()}
        self.value = {p: lib.get_score(i) for i, p in self.piece.items()}
        self.size = {i: len(p) for i, p in self.piece.items()}
        self.pairs: dict[int, bool] = {}
        self.held: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.letters = {c for p in self.number for c in p}
        self.parts = cuts(self.number)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.number.items():
            if self.merged(p) == [p]:
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()

    def merged(self, text: str) -> list[str]:
        """The merge rules on a short text: the best-scored pair first, of equals the leftmost."""
        pieces = list(text)
        while len(pieces) > 1:
            joint = [(-self.value[a + b], k) for k, (a, b) in enumerate(zip(pieces, pieces[1:], strict=False)) if a + b in self.value]
            if not joint:
                break
            k = min(joint)[1]
            pieces[k : k + 2] = [pieces[k] + pieces[k + 1]]
        return pieces

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merge rules leave the two pieces beside each other as they are."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > HELD_PAIRS:
                self.pairs.clear()
            a, b = self.piece[left], self.piece[right]
            known = self.pairs[key] = self.merged(a + b) == [a, b]
        return known

    def table(self, part: str) -> list[int]:
        """The last token of every prefix that is not empty."""
        last: list[int] = []
        pairs, compatible = self.pairs, self.compatible
        # places come in order, and at each the longest piece first
        for at, (size, token) in self.automaton.iter(part):
            if at != len(last):
                continue
            if size <= at:
                before = last[at - size]
                known = pairs.get(before << 32 | token)
                if known is None:
                    known = compatible(before, token)
                if not known:
                    continue
            last.append(token)
        if len(last) != len(part):
            raise ValueError(f"no piece ends at {len(last)} of {part!r}")
        return last

    def known_part(self, part: str) -> list[int]:
        """Ids of a part whose characters are all in the vocabulary, recovered backwards."""
        last, out, at, size = self.table(part), [], len(part), self.size
        while at:
            token = last[at - 1]
            out.append(token)
            at -= size[token]
        out.reverse()
        return out

    def part(self, part: str) -> bytes:
        """Ids of one part as little-endian unsigned 32-bit integers."""
        ids: list[int] = []
        start = 0
        for at, c in enumerate(part):
            if c not in self.letters:
                ids += self.known_part(part[start:at]) if at > start else []
                ids += [self.byte_ids[b] for b in c.encode()] if self.has_bytes else [self.unknown]
                start = at + 1
        ids += self.known_part(part[start:]) if start < len(part) else []
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """All ids, with begin and end, as little-endian unsigned 32-bit integers."""
        if len(self.held) > HELD_PARTS:
            self.held, self.older = {}, self.held
        held, older, out = self.held, self.older, []
        for part in self.parts.findall(self.library.normalize(text)) if text else ():
            ids = held.get(part)
            if ids is None:
                ids = older.get(part) or self.part(part)
                if len(part) <= HELD_CHARS:
                    held[part] = ids
            out.append(ids)
        ends = np.array([self.begin, self.end], dtype="<u4").tobytes()
        return ends[:4] + b"".join(out) + ends[4:]

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


def cuts(pieces) -> re.Pattern:
    """Parts of a normalised text that no piece reaches across.

    Openers are characters (the word mark, punctuation) that stand in a piece only at its beginning or
    behind another opener, so nothing is merged from an ordinary character to an opener. A line end
    that is in no piece is a part by itself.
    """
    letters = {c for p in pieces for c in p}
    openers = {c for c in letters if c == MARK or (c.isascii() and not c.isalnum())}
    while wrong := {b for p in pieces for a, b in zip(p, p[1:], strict=False) if b in openers and a not in openers}:
        openers -= wrong
    first = "".join(map(re.escape, sorted(openers)))
    lone = "" if "\n" in letters else "\n"
    if not first:
        return re.compile(f"[^{lone}]+|{lone}" if lone else "(?s:.+)")
    return re.compile(f"[{first}]+[^{first}{lone}]*|[^{first}{lone}]+" + (f"|{lone}" if lone else ""))


_LOADED: dict[str, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    """The encoder of a model; a worker keeps the one it used last."""
    name = hashlib.sha256(model).hexdigest()
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = Encoder(model)
    return _LOADED[name]


def read_model(path: str) -> bytes:
    """The content of a model file; it travels to the executors with the job (some hundred kB)."""
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row, ``ids`` an array of longs."""
    rows = pick(docs, key, text)

    def work(steps):
        with_model = encoder(model)
        for keys, texts in steps:
            yield [keys, [np.frombuffer(with_model.encode(t), "<u4").astype(np.int64) for t in texts]]

    return map_batches(rows, f"{key} {dict(rows.dtypes)[key]}, ids array<long>", work)


def decode(tokens: DataFrame, model: bytes, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of every row of ids; a null list decodes to null."""
    rows = pick(tokens, key, ids)

    def work(steps):
        with_model = encoder(model)
        for keys, lists in steps:
            yield [keys, [None if x is None else with_model.decode(np.array(x, dtype="<u4").tobytes()) for x in lists]]

    return map_batches(rows, f"{key} {dict(rows.dtypes)[key]}, text string", work)


def digests(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, then decoded again."""
    rows = pick(docs, key, text)

    def work(steps):
        with_model = encoder(model)
        for keys, texts in steps:
            ids = [with_model.encode(t) for t in texts]
            said = [hashlib.sha256(with_model.decode(x).encode()).hexdigest() for x in ids]
            yield [keys, [len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], said]

    return map_batches(rows, f"{key} {dict(rows.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string", work)
