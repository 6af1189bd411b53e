"""Two tokenizers' tokens of a text, aligned by bytes, and how often their ids go together.

Each byte of a text gets a label: no token ends there, one of A, one of B, or both. A
regular expression scans the labels for spans up to each "both"; the numbers of labels
in a span are the numbers of tokens in a group. The last tokens of a group end
together: they are a link.

Scale: texts are encoded once, and each row's distinct linked pairs are kept with their
numbers. Pairs are counted over all rows after a count in each task. The counts are
broadcast where they are at most BROADCAST_PAIRS; beyond, pairs that hold over a
thousandth of all rows' entries (a thousand at most) are broadcast and the others joined
by exchange, so no pair is one task.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import bpe
from .shared import prepare, stored, trimmed

#: Counted pairs (some 50 bytes each) that are broadcast.
BROADCAST_PAIRS = 1 << 20
#: Characters after which a text is cut for B, at a place where no token of B can cross.
CUT = 1 << 16
#: Label spans whose numbers a worker keeps, and the longest.
KEPT_SPANS, KEPT_SPAN = 1 << 16, 64

_LABELS = np.frombuffer(b".ab|", np.uint8)  # none, A ends, B ends, both
_SPAN = re.compile(rb"[^|]*\|")
#: White space that is too long for the compiled encoder's pattern.
_WIDE = re.compile(r"\s{1000}")


class _Numbers(dict):
    """Tokens of A and B in a span of labels, in one number."""

    def __missing__(self, span: bytes) -> int:
        n = (span.count(b"a") + 1) << 32 | (span.count(b"b") + 1)
        if len(span) <= KEPT_SPAN:
            if len(self) >= KEPT_SPANS:
                self.clear()
            self[span] = n
        return n


def group_sizes(a_ends: np.ndarray, b_ends: np.ndarray, n_bytes: int, kept: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of A and of B each group has. Both ends rise up to n_bytes."""
    if not n_bytes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    label = np.zeros(n_bytes, np.uint8)
    label[a_ends - 1] = 1
    label[b_ends - 1] += 2
    numbers = _Numbers() if kept is None else kept
    x = np.array(list(map(numbers.__getitem__, _SPAN.findall(_LABELS[label].tobytes()))), np.int64)
    return x >> 32, x & 0xFFFFFFFF


class Aligner:
    """Both tokenizers, with the bytes of each token."""

    def __init__(self, byte_bpe: str, pieces: str):
        import sentencepiece
        import tiktoken
        from sentencepiece import sentencepiece_model_pb2

        self.a, self.b = bpe.load(byte_bpe), sentencepiece.SentencePieceProcessor(model_file=pieces)
        merged = list(self.a.ranks.values())  # last rank first: rank in the upper bits, id in the lower
        ids = [v & 0xFFFFF for v in reversed(merged)]
        plain_tokens = {b: i for i, b in self.a.strings.items() if i not in set(self.a.special.values())}
        # ids in the order of ranks are themselves ranks, which is what the compiled encoder takes
        self.fast = tiktoken.Encoding("a", pat_str=bpe.PATTERN, mergeable_ranks=plain_tokens, special_tokens={}) if ids == sorted(ids) and set(plain_tokens.values()) == {*self.a.first, *ids} else None
        self.a_bytes = [self.a.strings[i] for i in range(max(self.a.strings) + 1)]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        with open(pieces, "rb") as f:
            rule = sentencepiece_model_pb2.ModelProto.FromString(f.read()).normalizer_spec
        plain = rule.name == "identity" and rule.add_dummy_prefix and not rule.remove_extra_whitespaces
        self.cut = re.compile("(?<=[^ ▁]) (?=[^ ▁])") if plain and not any(re.search("[^▁]▁", p) for p in names) else None
        digits = [str(i) for i in range(max(len(self.a_bytes), len(names)))]
        self.written = [d + e for e in ",|;" for d in digits]
        self.step, self.numbers = len(digits), _Numbers()

    def _parts(self, text: str) -> list[str]:
        """The text in parts that B encodes on their own to the same tokens: each begins where B puts a space before its first character anyway."""
        out, at = [], 0
        while self.cut is not None and len(text) - at > CUT and (m := self.cut.search(text, at + CUT)):
            out.append(text[at : m.start()])
            at = m.end()
        return [*out, text[at:]]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """Ids of A and B and the number of bytes of each text; nothing where the tokens of either don't make up its bytes."""
        parts = [self._parts(t) for t in texts]
        ids = iter(self.b.encode([p for x in parts for p in x], num_threads=1))
        out = []
        for text, x in zip(texts, parts, strict=True):
            b = [i for _ in x for i in next(ids)]
            data = b" " + text.encode()
            if not text or b"".join(map(self.b_bytes.__getitem__, b)) != data or b"".join(map(self.a_bytes.__getitem__, a := self._ids_of_a(" " + text))) != data:
                out.append((np.zeros(0, np.int64), np.zeros(0, np.int64), 0))
            else:
                out.append((np.array(a, np.int64), np.array(b, np.int64), len(data)))
        return out

    def _ids_of_a(self, text: str) -> list[int]:
        if self.fast is None or _WIDE.search(text):
            return np.frombuffer(self.a._plain(text), "<u4").tolist()
        return self.fast.encode_ordinary(text)

    def groups(self, a: np.ndarray, b: np.ndarray, n_bytes: int) -> tuple[np.ndarray, np.ndarray]:
        return group_sizes(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), n_bytes, self.numbers)

    def text_of(self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> str:
        """The groups as a1,a2|b1;a3|b2,b3."""
        if not len(na):
            return ""
        group_a, group_b = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
        end_a, end_b = np.cumsum(na), np.cumsum(nb)
        out = np.empty(len(a) + len(b), np.int64)
        at_a, at_b = np.arange(len(a)) + (end_b - nb)[group_a], np.arange(len(b)) + end_a[group_b]
        out[at_a], out[at_b] = a, b
        out[at_a[end_a - 1]] += self.step
        out[at_b[end_b - 1]] += 2 * self.step
        return "".join(map(self.written.__getitem__, out.tolist()))[:-1]


@functools.cache
def load(byte_bpe: str, pieces: str) -> Aligner:
    return Aligner(byte_bpe, pieces)


_LONG, _LONGS = T.LongType(), T.ArrayType(T.LongType())
_TYPES = {"n_a": _LONG, "n_b": _LONG, "n_groups": _LONG, "n_links": _LONG, "groups": T.StringType(), "groups_sha256": T.StringType(), "pairs": _LONGS, "times": _LONGS}


def align_tokens(docs: DataFrame, byte_bpe: str, pieces: str, text_col: str = "text", outputs: tuple[str, ...] = ("n_a", "n_b", "n_groups", "n_links", "groups")) -> DataFrame:
    """Each row with the outputs asked for: n_a, n_b (tokens), n_groups, n_links, groups
    (as a1,a2|b1;a3|b2,b3), groups_sha256 ('' without tokens), pairs (distinct linked ids,
    A's in the upper 32 bits) and times (links of each).

    byte_bpe and pieces are paths that every worker can read, of a byte-level BPE JSON and a
    sentencepiece model. Special tokens' strings are plain text. A text that is null, empty,
    or not the bytes of its tokens has none: zeros and empty values. Texts are taken whole.
    Rows aren't merged; input columns named like an output are replaced; an empty table
    stays empty.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    prepare(docs.sparkSession)
    names = [c for c in docs.columns if c not in outputs]
    docs = docs.select(*(f"`{c}`" for c in names))
    kind = T.StructType([*docs.schema.fields, *(T.StructField(c, _TYPES[c]) for c in outputs)])
    schema = to_arrow_schema(kind)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(byte_bpe, pieces)
        for batch in batches:
            for lo in range(0, len(batch), 50):
                part = batch.slice(lo, 50)
                made: dict[str, list] = {c: [] for c in _TYPES}
                for a, b, n in model.encode([t or "" for t in part.column(text_col).to_pylist()]):
                    na, nb = model.groups(a, b, n)
                    for c, v in (("n_a", len(a)), ("n_b", len(b)), ("n_groups", len(na)), ("n_links", len(na))):
                        made[c].append(v)
                    if "groups" in outputs or "groups_sha256" in outputs:
                        made["groups"].append(text := model.text_of(a, b, na, nb))
                        made["groups_sha256"].append(hashlib.sha256(text.encode()).hexdigest() if text else "")
                    if "pairs" in outputs or "times" in outputs:
                        pairs, times = np.unique(a[np.cumsum(na) - 1] << 32 | b[np.cumsum(nb) - 1], return_counts=True)
                        made["pairs"].append(pairs)
                        made["times"].append(times)
                yield pa.record_batch([part.column(c) for c in names] + [pa.array(made[c], schema.field(c).type) for c in outputs], schema=schema)

    return docs.mapInArrow(trimmed(of), kind)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, entries, best) of links (pairs, times): how many links each pair of ids has over all rows, in how many rows, and whether no other pair of its B id has more. No links give no rows."""
    x = links.select(F.inline(F.arrays_zip(F.col("pairs"), F.col("times")))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n"), F.count("*").alias("entries"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))  # rows: A's vocabulary at most
    return x.select("pair", "n", "entries", (F.col("n") == F.max("n").over(of_b)).alias("best"))


def link_scores(links: DataFrame, key: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(key, n_best, count_sum) of links (key, pairs, times), for keys that have any: links whose pair is its B id's most frequent one (ties included), and the sum of all links' counts."""
    counts = stored(pair_counts(links), "pair-counts")
    size = counts.agg(F.count("*").alias("pairs"), F.sum("entries").alias("entries")).first()
    x = links.select(key, F.inline(F.arrays_zip(F.col("pairs"), F.col("times")))).withColumnRenamed("pairs", "pair")
    known = counts.select("pair", "n", "best")
    if size.pairs <= broadcast_pairs:
        both = x.join(F.broadcast(known), "pair")
    else:
        heavy = F.col("entries") > (size.entries or 0) / 1000
        both = x.join(F.broadcast(counts.where(heavy).select("pair", "n", "best")), "pair", "left")
        far = both.where("n is null").select("pair", key, "times").join(counts.where(~heavy).select("pair", "n", "best"), "pair")
        both = both.where("n is not null").unionByName(far)
    return both.groupBy(key).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))


def aligned_documents(docs: DataFrame, byte_bpe: str, pieces: str, text_col: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Each row without its text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    Counts are over all rows; rows that repeat an id are rows of their own. Null and empty
    texts have zeros. Input columns named like an output or __row are replaced or dropped;
    an empty table stays empty.
    """
    own = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    rest = [f"`{c}`" for c in docs.columns if c not in (*own, text_col, "n_best", "count_sum", "pairs", "times", "__row")]
    rows = docs.select(*rest, F.col(f"`{text_col}`").alias("__text"), F.monotonically_increasing_id().alias("__row"))  # fixed by the table that is written
    x = stored(align_tokens(rows, byte_bpe, pieces, "__text", (*own, "pairs", "times")).drop("__text"), "alignment")
    scores = link_scores(x.select("__row", "pairs", "times"), "__row", broadcast_pairs)
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return x.join(scores, "__row", "left").select(*rest, "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups_sha256")
