"""Quality rules whose cutoffs adapt to each language and source.

Median and upper quantile of every measure are taken per group from mergeable quantile
sketches over all documents; a cutoff lies beyond the upper quantile by a multiple of
its distance from the median. A group's figures are drawn towards its language's, and
a language's towards those of all, by the number of its rows against PRIOR_ROWS, so
that every group counts and none switches at a size. Documents are then joined with
their group's cutoffs. All of it is DataFrame functions.

Scale: measures are a small table without the texts. Sketches of each level are
merged from each task's, so a group with a third of all rows costs one sketch a
task. Cutoffs are broadcast only if there are at most SMALL of them, else joined with
the groups' rows split by salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANKS, prepare, stored

SYMBOLS = "#*$%&|<>"
#: Accuracy of the sketches; up to so many rows of a group they are exact.
ACCURACY = 10_000
#: Groups up to which the cutoffs are broadcast, and salts beyond.
SMALL, SALTS = 10_000, 32
#: Rows of the parent that count beside a group's own: a group of so many rows has figures halfway between.
PRIOR_ROWS = 200
#: The sketch's quantiles that a cutoff is made of, and how many of their distances it lies beyond the upper one.
QUANTILES, FENCE = (0.5, 0.9), 4
#: Measures in thousandths, and what counts as the quantiles' distance where they are equal (fixed values), as where nearly all documents have 0.
SPREAD = {"symbols_pm": 40, "dup_lines_pm": 100, "repeats_pm": 50, "word_length_pm": 250}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def _len(c: Column) -> Column:
    return F.coalesce(F.length(c), F.lit(0)).cast("long")


def with_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Each row with n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words (long).

    Words are runs of anything but space, tab to carriage return. n_lines counts
    \\n-split lines with a word, n_dup_lines those equal to an earlier line,
    n_repeat_words the words in 3-word windows that the text has twice or more.
    A null or empty text has 0 of each.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    carried = [F.col(f"`{c}`") for c in docs.columns if c not in MEASURES]
    x = docs.select(*carried, words.alias("__w"), lines.alias("__l"), F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"))
    n = F.size("__w")
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    x = x.select(*carried, _len(F.array_join("__w", "")).alias("word_chars"), "n_symbols", n.cast("long").alias("n_words"), F.size("__l").cast("long").alias("n_lines"), (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"), grams.alias("__g"))
    # places of windows with an equal one: neighbours in the order of hash and place; then the union of their words
    order = F.sort_array(F.transform("__g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    x = x.withColumn("__s", F.when(F.size(F.array_distinct("__g")) < F.size("__g"), order))
    twice = F.filter(F.transform("__s", lambda e, k: F.when((F.get("__s", k - 1).h == e.h) | (F.get("__s", k + 1).h == e.h), e.i)), lambda i: i.isNotNull())
    x = x.withColumn("__p", F.sort_array(twice))
    covered = F.aggregate("__p", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda acc, i: F.struct(i.alias("last"), (acc.n + F.least(F.lit(3), i - acc["last"]).cast("long")).alias("n")), lambda acc: acc.n)
    return x.select(*carried, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _thousandths() -> dict[str, Column]:
    def per(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.floor(F.col(a) * 1000 / F.col(b))).otherwise(F.lit(0)).cast("long")

    return {"symbols_pm": per("n_symbols", "word_chars"), "dup_lines_pm": per("n_dup_lines", "n_lines"), "repeats_pm": per("n_repeat_words", "n_words"), "word_length_pm": per("word_chars", "n_words")}


def _cutoffs(x: DataFrame, keys: list[str]) -> DataFrame:
    """keys and max_* of each group: upper quantile and distance from the sketches, in millionths, drawn towards the parents' level by level."""
    some = x.where("not base_failed").rollup(*keys).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), *(F.percentile_approx(m, list(QUANTILES), ACCURACY).alias(m) for m in SPREAD))
    own = []
    for m, spread in SPREAD.items():
        mid, high = F.get(m, F.lit(0)), F.get(m, F.lit(1))
        own += [(1000 * high).alias(f"high_{m}"), (1000 * F.when(high > mid, high - mid).otherwise(F.lit(spread))).alias(f"distance_{m}")]
    some = stored(some.select(*keys, "level", "n", *own), "sketches")
    figures = [f"{c}_{m}" for m in SPREAD for c in ("high", "distance")]
    out = some.where(F.col("level") == (1 << len(keys)) - 1).select(*figures)  # all rows: one row, without a parent
    for i in range(1, len(keys) + 1):
        parent = out.withColumnsRenamed({c: f"__{c}" for c in figures})
        level = some.where(F.col("level") == (1 << len(keys) - i) - 1)
        both = level.join(parent, keys[: i - 1]) if i > 1 else level.join(F.broadcast(parent))
        out = both.select(*keys[:i], *(F.expr(f"(n * {c} + {PRIOR_ROWS} * __{c}) div (n + {PRIOR_ROWS})").alias(c) for c in figures))
    return stored(out.select(*keys, *(F.expr(f"(high_{m} + {FENCE} * distance_{m}) div 1000").alias(f"max_{m}") for m in SPREAD)), "cutoffs")


def apply_quality_rules(docs: DataFrame, texts: bool = True, text_col: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Each row with its measures, base_failed and kept (boolean); without texts, all columns but the text.

    base_failed: fewer than 50 words, or more than half of them in repeated
    3-word windows. Others are kept unless a measure (symbols for each character
    of words, repeated lines, words in repeated windows, mean word length; in
    thousandths) is above its group's cutoff: the 0.9 quantile and FENCE times its
    distance from the median, which is SPREAD where both are equal; what spoils
    less than a tenth of a large group can't move it. Both figures come from all rows of
    the group that passed the base rules, and are averaged with those of the first
    column's value, themselves averaged with those of all rows: the group's with the
    weight of its rows, the parent's with PRIOR_ROWS. Nulls in a group column are a group of their own. Null and empty texts
    fail the base rules. Repeated rows count each. Input columns named like an output
    are replaced; an empty table stays empty.
    """
    spark = docs.sparkSession
    prepare(spark)
    names = [c for c in docs.columns if c not in (*MEASURES, "base_failed", "kept")]
    keys = [f"__k{i}" for i in range(len(by))]

    def measured(carried: list[str]) -> DataFrame:
        x = with_measures(docs.select(*carried, *([] if text_col in carried else [text_col]), *(F.coalesce(F.col(c).cast("string"), F.lit("\0null")).alias(k) for c, k in zip(by, keys, strict=True))), text_col)
        x = x.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).withColumns(_thousandths())
        return x if text_col in carried else x.drop(text_col)

    if texts:  # measured twice, so that no text is stored
        x, small = measured(names), stored(measured([]), "measures")
    else:
        names = [c for c in names if c != text_col]
        x = small = stored(measured(names), "measures")
    cut = _cutoffs(small, keys)
    if cut.count() <= SMALL:
        j = x.join(F.broadcast(cut), keys, "left")
    else:
        salted = x.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in names[:1]], "n_words", "word_chars"), F.lit(SALTS)))
        j = salted.join(cut.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [*keys, "__salt"], "left")
    good = ~F.col("base_failed")
    for m in SPREAD:
        good = good & F.coalesce(F.col(m) <= F.col(f"max_{m}"), F.lit(True))
    return j.select(*(F.col(f"`{c}`") for c in names), *MEASURES, "base_failed", good.alias("kept"))
