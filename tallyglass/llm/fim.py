"""Fill-in-the-middle: a text's parts in another order, behind sentinels, and back.

A text is decoded to a numpy array of code points (UTF-32). Each is blank or not; where
a blank follows another code point a unit begins (the white space before a word belongs
to it), so comparing neighbouring classes and flatnonzero give all boundaries at once.
Two ranks chosen by a hash of the seed and the id index them; the three slices are
encoded again and put in order.

Scale: one pass without an exchange; a task holds one batch and one text's code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import prepare, trimmed


@dataclass(frozen=True)
class Sentinels:
    """Strings before prefix, suffix and middle. None may be empty or share an end with another's start, else an output could be read in two ways."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        for a in self.all:
            for b in self.all:
                if not a or (a != b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b))):
                    raise ValueError(f"sentinels {a!r} and {b!r} can't be told apart in every text")

    @property
    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def unit_bounds(points: np.ndarray) -> np.ndarray:
    """Where units begin, and the end: n + 1 numbers for n units, one for an empty text."""
    if not len(points):
        return np.zeros(1, np.int64)
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    return np.concatenate([[0], np.flatnonzero(blank[1:] & ~blank[:-1]) + 1, [len(points)]])


def draws(seed: int, key: object) -> list[int]:
    """Four numbers below 2^32, from the seed and an id."""
    h = hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()
    return [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]


def transform(text: str, key: object, seed: int, rate: int, spm: int, s: Sentinels) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and output of one text."""
    points = codepoints(text)
    at = unit_bounds(points)
    n = len(at) - 1
    h1, h2, h3, h4 = draws(seed, key)
    if not text or h3 % 100 >= rate or any(x in text for x in s.all):
        return n, "plain", None, None, text
    lo, hi = at[sorted((h1 % (n + 1), h2 % (n + 1)))].tolist()
    prefix, middle, suffix = (x.tobytes().decode("utf-32-le") for x in (points[:lo], points[lo:hi], points[hi:]))
    form, parts = ("spm", (s.suffix, suffix, s.prefix, prefix)) if h4 % 100 < spm else ("psm", (s.prefix, prefix, s.suffix, suffix))
    return n, form, lo, hi - lo, "".join((*parts, s.middle, middle))


def restore(output: str, form: str, s: Sentinels) -> str:
    """The text behind an output. An output that doesn't have its form is an error."""
    if form == "plain":
        return output
    first, second = (s.prefix, s.suffix) if form == "psm" else (s.suffix, s.prefix)
    start, _, rest = output.partition(first)
    a, one, rest = rest.partition(second)
    b, two, middle = rest.partition(s.middle)
    if form not in ("psm", "spm") or start or not (one and two):
        raise ValueError(f"no output of the form {form}: {output[:60]!r}")
    return a + middle + b if form == "psm" else b + middle + a


_TYPES = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType(), "output_sha256": T.StringType(), "restored_sha256": T.StringType()}


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, sentinels: Sentinels = Sentinels(), text_col: str = "text", id_col: str = "doc_id", outputs: tuple[str, ...] = ("n", "form", "prefix_chars", "middle_chars", "output")) -> DataFrame:  # noqa: B008
    """Each row with the outputs asked for: n (units), form (plain, psm or spm), prefix_chars,
    middle_chars (code points; null if plain), output, output_sha256, restored_sha256 (of
    the text rebuilt from output and form).

    rate: per cent of the texts that are transformed; spm: per cent of these with the
    suffix first. A text that holds a sentinel, and an empty one, stays plain. A null text
    counts as empty. A null id draws by the word null. Rows that repeat an id draw alike;
    rows aren't merged. Texts are taken whole. Input columns named like an output are
    replaced; an empty table stays empty.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    prepare(docs.sparkSession)
    names = [c for c in docs.columns if c not in outputs]
    docs = docs.select(*(f"`{c}`" for c in names))
    kind = T.StructType([*docs.schema.fields, *(T.StructField(c, _TYPES[c]) for c in outputs)])
    schema = to_arrow_schema(kind)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 100):
                part = batch.slice(lo, 100)
                texts, keys = (part.column(c).to_pylist() for c in (text_col, id_col))
                rows = [transform(t or "", k, seed, rate, spm, sentinels) for t, k in zip(texts, keys, strict=True)]
                made = dict(zip(("n", "form", "prefix_chars", "middle_chars", "output"), map(list, zip(*rows, strict=True)), strict=True))
                if "output_sha256" in outputs:
                    made["output_sha256"] = [_hex(r[4]) for r in rows]
                if "restored_sha256" in outputs:
                    made["restored_sha256"] = [_hex(restore(r[4], r[1], sentinels)) for r in rows]
                yield pa.record_batch([part.column(c) for c in names] + [pa.array(made[c], schema.field(c).type) for c in outputs], schema=schema)

    return docs.mapInArrow(trimmed(of), kind)
