"""Byte-level BPE encoding and decoding of whole texts.

A text is cut at special tokens and then into pieces by the tokenizer's pattern.
A piece is encoded by a priority queue of the merge ranks of neighbouring symbols
over a doubly linked list of symbols; a merge leaves the entries of the pairs that
it broke in the queue, and they are skipped when they come up. Decoding joins the
vocabulary's strings. Each worker keeps the ids of words it has met, up to a fixed number.

Scale: one pass without an exchange. Memory is the vocabulary, the kept words and
one batch.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import prepare, trimmed

#: The pieces' pattern of byte-level tokenizers (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a worker keeps in each of its two generations, and the longest that it keeps.
KEPT_WORDS, KEPT_LENGTH = 1 << 18, 64


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a vocabulary: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """Packed ids of words met so far behind a fixed string; the older generation goes when the younger is full."""

    def __init__(self, model: ByteBPE, before: str):
        super().__init__()
        self.model, self.before, self.older = model, before, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.model._pieces(self.before + word)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


def check_supported(model: dict) -> None:
    """An error for what a tokenizer's JSON asks for beyond plain byte-level BPE with GPT-2's pattern: it would give other ids."""
    core, cut = model["model"], model.get("pre_tokenizer") or {}
    wrong = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if core.get(k)]
    wrong += [f"added token {t['content']!r} with {k}" for t in model.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized") if t.get(k)]
    if core.get("type", "BPE") != "BPE":
        wrong.append(f"model {core.get('type')}")
    if model.get("normalizer"):
        wrong.append("a normalizer")
    if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        wrong.append("another pre-tokenizer than ByteLevel with its own pattern and without a prefix space")
    if wrong:
        raise ValueError(f"the tokenizer has what isn't supported: {', '.join(wrong)}")


class ByteBPE:
    """A byte-level BPE model read from a tokenizer's JSON."""

    def __init__(self, model: dict):
        check_supported(model)
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        vocab: dict[str, int] = model["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        self.first = [vocab[letters[b]] for b in range(256)]
        self.ranks = {vocab[a] << 20 | vocab[b]: rank << 20 | vocab[a + b] for rank, (a, b) in reversed(list(enumerate(merges)))}
        self.strings: dict[int, bytes] = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.special: dict[str, int] = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.pieces = regex.compile(PATTERN)
        self.heads, self.tails = _Words(self, ""), _Words(self, " ")

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece. A queue entry holds the pair's rank, its new id and its place; now has each place's valid pair."""
        sym = [self.first[b] for b in piece]
        n = len(sym)
        find = self.ranks.get
        now = [find(a << 20 | b, -1) for a, b in zip(sym, sym[1:], strict=False)]
        now.append(-1)
        shift = n.bit_length()
        low = (1 << shift) - 1
        queue = [v << shift | i for i, v in enumerate(now) if v >= 0]
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heapq.heappop(queue)
            i, v = entry & low, entry >> shift
            if now[i] != v:
                continue  # stale: one of its symbols has been merged since
            new = v & 0xFFFFF
            j = after[i]
            k = after[i] = after[j]
            sym[i], sym[j], now[i], now[j] = new, -1, -1, -1
            if k < n:
                before[k] = i
                v = now[i] = find(new << 20 | sym[k], -1)
                if v >= 0:
                    heapq.heappush(queue, v << shift | i)
            h = before[i]
            if h >= 0:
                v = now[h] = find(sym[h] << 20 | new, -1)
                if v >= 0:
                    heapq.heappush(queue, v << shift | h)
        return [s for s in sym if s >= 0]

    def _pieces(self, text: str) -> bytes:
        """A word of several pieces joins what is kept for them; a piece cut again stays whole."""
        found = self.pieces.findall(text)
        if len(found) == 1:
            return self.packed(self.merge(text.encode()))
        return b"".join([self.tails[p[1:]] if p[0] == " " else self.heads[p] for p in found])

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, text: str) -> bytes:
        """Where no other white space is about, each single space starts a piece and each single line feed is one, so words are looked up whole."""
        pieces = text.split("\n")
        if not text or "  " in text or not all(x.isprintable() and x and x[0] != " " and x[-1] != " " for x in pieces):
            return b"".join(map(self.heads.__getitem__, self.pieces.findall(text)))
        lines, tails = [], self.tails.__getitem__
        for line in pieces:
            words = line.split(" ")
            first = self.heads[words[0]]
            lines.append(first + b"".join(map(tails, words[1:])) if len(words) > 1 else first)
        return self.heads["\n"].join(lines)

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if self.cut is None or not (found := list(self.cut.finditer(text))):
            return self._plain(text)
        out, at = [], 0
        for m in found:
            out += [self._plain(text[at : m.start()]), self.packed([self.special[m[0]]])]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids) -> str:
        """The vocabulary's strings, joined; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@functools.cache
def load(path: str) -> ByteBPE:
    with open(path, encoding="utf-8") as f:
        return ByteBPE(json.load(f))


def _encoded(path: str, text_col: str, names: list[str], wanted: tuple[str, ...], schema: pa.Schema):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for lo in range(0, len(batch), 100):
                part = batch.slice(lo, 100)
                packed = [model.encode_packed(t or "") for t in part.column(text_col).to_pylist()]
                made: dict[str, list] = {"n_tokens": [len(x) // 4 for x in packed]}
                if "ids" in wanted:
                    made["ids"] = [np.frombuffer(x, "<i4") for x in packed]
                if "ids_sha256" in wanted:
                    made["ids_sha256"] = [hashlib.sha256(x).hexdigest() for x in packed]
                if "decoded" in wanted or "decoded_sha256" in wanted:
                    made["decoded"] = [model.decode(np.frombuffer(x, "<u4").tolist()) for x in packed]
                if "decoded_sha256" in wanted:
                    made["decoded_sha256"] = [hashlib.sha256(x.encode()).hexdigest() for x in made["decoded"]]
                yield pa.record_batch([part.column(c) for c in names] + [pa.array(made[c], schema.field(c).type) for c in wanted], schema=schema)

    return of


_TYPES = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "ids_sha256": T.StringType(), "decoded": T.StringType(), "decoded_sha256": T.StringType()}


def bpe_encode(docs: DataFrame, tokenizer: str, text_col: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids")) -> DataFrame:
    """Each row with the outputs asked for: n_tokens, ids, ids_sha256 (of the ids as
    little-endian 32-bit integers), decoded, decoded_sha256 (of its UTF-8).

    tokenizer is the path of a byte-level BPE JSON that every worker can read.
    A special token's string in a text becomes that token. A null text counts as
    empty: no ids, decoded "". Long texts are encoded whole. Rows aren't merged;
    input columns named like an output are replaced; an empty table stays empty.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    prepare(docs.sparkSession)
    names = [c for c in docs.columns if c not in outputs]
    docs = docs.select(*names)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, _TYPES[c]) for c in outputs)])
    return docs.mapInArrow(trimmed(_encoded(tokenizer, text_col, names, tuple(outputs), to_arrow_schema(schema))), schema)


def bpe_decode(rows: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Each row with out_col, the text of its ids. Null ids give null; unknown ids are an error."""

    @F.pandas_udf(T.StringType())
    def decoded(ids):
        model = load(tokenizer)
        return ids.map(lambda x: None if x is None else model.decode(x))

    prepare(rows.sparkSession)
    return rows.withColumn(out_col, decoded(ids_col))
