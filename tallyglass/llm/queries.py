"""Queries of the pipeline's operators, over whole tables, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, fim, jaccard_join, mixing, quality_rules, substring_dedup, token_alignment, token_counts, topk_search, toxicity, url_filter, warc
from .shared import crc_mod

TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.bpe_encode(docs, public_tokenizers.path(TOKENIZER), outputs=("n_tokens", "ids_sha256", "decoded_sha256")).drop("text")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return toxicity.score_toxicity(docs, net).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("text")
    return token_counts.context_limits(token_counts.length_histogram(docs, public_tokenizers.path(TOKENIZER)))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), texts=False).select("doc_id", "size", "source_size", "target", "taken")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _table(spark, sf_dir, "embeddings").select("vec_id", topk_search.integer_components(F.col("embedding")).alias("vector"))
    return topk_search.top_k(x, x.where("vec_id % 50 = 0"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    groups = jaccard_join.jaccard_groups(docs, k=3, similarity=(90, 100))
    return groups.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup_substrings(docs, window=20).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules.apply_quality_rules(docs, texts=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, _ = warc.write_archives(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read_archives(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return fim.fill_in_middle(docs, outputs=("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")).drop("text")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_alignment.aligned_documents(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat_format.chat_digests(_table(spark, sf_dir, "conversations").select(*own.columns).unionByName(own))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe, op2_toxicity, op3_token_counts, op4_mixing, op5_url_filter, op6_topk, op7_jaccard, op8_substring_dedup, op9_quality, op10_warc, op11_fim, op12_alignment, op13_chat)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op4_mixing": f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source),
w AS (SELECT source, n, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY n::DOUBLE / w, source NULLS LAST) AS k FROM w),
c AS (SELECT *, 3 * sum(n) OVER () - 4 * coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num,
  2 * sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS den FROM r),
f AS (SELECT min(k) AS k FROM c WHERE num * w <= 2 * n * den),
e AS (SELECT c.num, c.den, f.k FROM c JOIN f USING (k)),
t AS (SELECT c.source, c.n, CASE WHEN e.k IS NULL OR c.k < e.k THEN 2 * c.n ELSE CAST(floor(e.num * c.w / e.den) AS BIGINT) END AS q,
  CASE WHEN e.k IS NULL OR c.k < e.k THEN 2.0 * c.n ELSE CAST(e.num * c.w AS DOUBLE) / CAST(e.den AS DOUBLE) END AS target FROM c LEFT JOIN e ON true),
u AS (SELECT d.*, t.n, t.q, t.target, CASE WHEN t.n > 0 THEN t.q // t.n ELSE 0 END AS passes, CASE WHEN t.n > 0 THEN t.q % t.n ELSE 0 END AS rest,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target, CAST(passes * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM u""",
    "op6_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM p),
m AS (SELECT doc_id, i, (doc_id, i) > min((doc_id, i)) OVER (PARTITION BY g) AS again FROM g),
x AS (SELECT DISTINCT doc_id, i + k AS i FROM m, range(20) t(k) WHERE again),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT u.doc_id, count(*) FILTER (WHERE x.i IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY u.i) FILTER (WHERE x.i IS NULL) AS kept
  FROM u LEFT JOIN x ON u.doc_id = x.doc_id AND u.i = x.i GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op9_quality": rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM p),
x AS (SELECT doc_id, CAST(count(DISTINCT i + k) AS BIGINT) AS n FROM g, range(3) r(k) WHERE g.n > 1 GROUP BY doc_id),
m AS (SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  coalesce(x.n, 0) AS n_repeat_words FROM d LEFT JOIN x USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  CASE WHEN word_chars > 0 THEN n_symbols * 1000 // word_chars ELSE 0 END AS a1, CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS a2,
  CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS a3, CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS a4 FROM m),
l AS (SELECT grouping_id(lang0, source0) AS level, lang0, source0, count(*) AS n, {", ".join(f"1000 * quantile_disc(a{i}, 0.9) AS h{i}, 1000 * CASE WHEN quantile_disc(a{i}, 0.9) > quantile_disc(a{i}, 0.5) THEN quantile_disc(a{i}, 0.9) - quantile_disc(a{i}, 0.5) ELSE {spread} END AS d{i}" for i, spread in enumerate(quality_rules.SPREAD.values(), 1))}
  FROM (SELECT *, coalesce(lang, chr(1)) AS lang0, coalesce(source, chr(1)) AS source0 FROM b) WHERE NOT base_failed GROUP BY ROLLUP (lang0, source0)),
p1 AS (SELECT g.lang0, {", ".join(f"(g.n * g.{c} + {quality_rules.PRIOR_ROWS} * a.{c}) // (g.n + {quality_rules.PRIOR_ROWS}) AS {c}" for i in (1, 2, 3, 4) for c in (f"h{i}", f"d{i}"))} FROM l g JOIN l a ON a.level = 3 WHERE g.level = 1),
p0 AS (SELECT g.lang0, g.source0, {", ".join(f"(g.n * g.{c} + {quality_rules.PRIOR_ROWS} * a.{c}) // (g.n + {quality_rules.PRIOR_ROWS}) AS {c}" for i in (1, 2, 3, 4) for c in (f"h{i}", f"d{i}"))} FROM l g JOIN p1 a ON a.lang0 = g.lang0 WHERE g.level = 0),
q AS (SELECT lang0, source0, {", ".join(f"(h{i} + {quality_rules.FENCE} * d{i}) // 1000 AS c{i}" for i in (1, 2, 3, 4))} FROM p0)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND a1 <= c1 AND a2 <= c2 AND a3 <= c3 AND a4 <= c4 AS kept
FROM b LEFT JOIN q ON coalesce(b.lang, chr(1)) = q.lang0 AND coalesce(b.source, chr(1)) = q.source0""",
    "op10_warc": """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f""",
    "op11_fim": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
r AS (SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) for i in range(4)] AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS lo, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, coalesce(array_to_string(w[1:lo], ''), '') AS a, coalesce(array_to_string(w[lo + 1:hi], ''), '') AS b, coalesce(array_to_string(w[hi + 1:], ''), '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || z || '<P>' || a || '<M>' || b ELSE '<P>' || a || '<S>' || z || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op13_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (SELECT *, length(text) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?(INST|ANS|ROLE)\]|<\\*</?SYS>>')) + CASE role WHEN 'user' THEN 22 WHEN 'assistant' THEN 20 WHEN 'system' THEN 24 ELSE length(role) + 24 END AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars FROM m GROUP BY conv_id""",
}
