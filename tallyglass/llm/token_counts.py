"""Token counts of a corpus for every context limit, from an exact histogram of lengths."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import load
from .shared import prepare, stored, trimmed

#: Lengths of one block of the suffix sums.
BLOCK = 1024


def _lengths(path: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            yield pa.record_batch([pa.array([len(model.encode_packed(t or "")) // 4 for t in batch.column(0).to_pylist()], pa.int64())], names=["length"])

    return of


def length_histogram(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """(length, n_docs): how many documents have so many tokens, over whole texts of all rows.

    A null text counts as empty, of length 0; repeated rows count each; an empty
    table gives an empty histogram. Counts are summed before the exchange.
    """
    prepare(docs.sparkSession)
    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(_lengths(tokenizer)), "length long").groupBy("length").agg(F.count("*").alias("n_docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, as a context limit: docs_over (longer ones), tokens_within
    (of documents that fit), tokens_truncated (of all documents, each cut at the limit),
    tokens_total, and quantile (share of documents that fit).

    A limit between two lengths keeps the lower one's docs_over and tokens_within;
    its truncated total is tokens_within + limit * docs_over. Suffix sums run in
    blocks of lengths, then over the blocks' sums, so no task gets all lengths.
    The histogram is written first: two plans read it, and each would encode all texts.
    """
    h = stored(histogram, "lengths").withColumn("block", F.floor(F.col("length") / BLOCK))
    sums = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("length")).alias("t"))
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select("block", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"), F.sum("d").over(everything).alias("docs"), F.sum("t").over(everything).alias("tokens_total"))
    longer = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    x = h.join(sums, "block").withColumns({
        "docs_over": F.col("d_above") + F.coalesce(F.sum("n_docs").over(longer), F.lit(0)),
        "tokens_over": F.col("t_above") + F.coalesce(F.sum(F.col("n_docs") * F.col("length")).over(longer), F.lit(0)),
    })
    within = F.col("tokens_total") - F.col("tokens_over")
    return x.select("length", "n_docs", "docs_over", within.alias("tokens_within"), (within + F.col("length") * F.col("docs_over")).alias("tokens_truncated"), "tokens_total", ((F.col("docs") - F.col("docs_over")) / F.col("docs")).alias("quantile"))


def length_quantile(limits: DataFrame, q: float) -> int | None:
    """The smallest length that at least a share q of the documents don't exceed; None without documents."""
    return limits.where(F.col("quantile") >= q).agg(F.min("length")).first()[0]


def truncated_total(limits: DataFrame, limit: int) -> int:
    """Tokens left of all documents when each is cut at the limit."""
    row = limits.where(F.col("length") <= limit).agg(F.max_by(F.struct("tokens_within", "docs_over"), "length").alias("x")).first().x
    if row is None:
        return limit * (limits.agg(F.sum("n_docs")).first()[0] or 0)
    return row.tokens_within + limit * row.docs_over
