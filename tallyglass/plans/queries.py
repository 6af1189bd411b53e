"""Queries over the test tables, each with the same in SQL."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.canon import encode_fields
from ..functions.hashing import fingerprints
from ..functions.proof import Ed25519, evidence_counts, verify_documents
from ..functions.model import Boundary, CanonSpec, DuplicatePolicy, Policy, Tolerances, check_schema_drift
from ..operators import faults
from ..operators.leaks import leaked_values
from ..operators.log import consistency_proofs, log_levels
from ..operators.merkle import commutative_root, inclusion_proofs, merkle_root, verified_inclusion
from ..operators.chain import chain_links
from ..operators.hops import hop_faults, hop_summary
from ..operators.prefilter import prefilter
from ..operators.reconcile import Reconciliation, balanced, honest, multiset_except, multiset_intersect, reconcile, verdict_of
from ..operators.transform import Transform, reconcile_transformed
from .document import build_document, verify_with_tables
from ..sources.boundary import offset_range, snapshot_range, time_window
from ..sources.completeness import completeness, offset_gaps
from ..sources.connectors import KafkaLog, SnapshotTable, row_hash
from ..sources.delta import DeltaTable
from ..sources.segments import read_segments, write_segments
from ..sources.stores import scratch
from ..streaming.continuous import buckets_for, continuous, run_continuous

SALT = bytes([0xAB]) * 32
ORDERS = Policy("field:o_orderkey", ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))
LINES = Policy("composite:[l_orderkey,l_linenumber]", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"))
EVENTS = Policy("field:event_id", ("event_id", "ts", "user_id", "event_type", "value", "props"), exclude_fields=("props",))
LINE_ORDER = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hexa(*names: str) -> list[Column]:
    return [F.lower(F.hex(n)).alias(n) for n in names]


# --- the same in SQL ----------------------------------------------------------------------------


def u32_sql(n: str) -> str:
    return f"unhex(printf('%08x', {n}))"


def text_sql(tag: str, text: str) -> str:
    return f"coalesce(unhex('{tag}') || {u32_sql(f'octet_length(encode({text}))')} || encode({text}), unhex('A0'))"


KIND_SQL = {"string": lambda c: text_sql("A2", c), "int": lambda c: text_sql("A2", f"CAST({c} AS VARCHAR)"), "double": lambda c: text_sql("A3", f"format('{{:.6f}}', {c})"), "timestamp": lambda c: text_sql("A4", f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%fZ')"), "bool": lambda c: f"coalesce(CASE WHEN {c} THEN unhex('A101') ELSE unhex('A100') END, unhex('A0'))"}
KINDS = {"o_totalprice": "double", "o_orderdate": "timestamp", "l_quantity": "double", "l_extendedprice": "double", "l_shipdate": "timestamp", "value": "double", "ts": "timestamp"} | dict.fromkeys(("o_orderstatus", "o_orderpriority", "l_returnflag", "event_type", "props"), "string")


def fields_sql(names: list[str]) -> str:
    return " || ".join(f"unhex('F0{len(n):08x}{n.encode().hex()}') || {KIND_SQL[KINDS.get(n, 'int')](n)}" for n in names)


def fp_sql(rows: str, policy: Policy, *carried: str) -> str:
    """id_hash, content_hash, fp as blobs."""
    more = "".join(f", {c}" for c in carried)
    s = SALT.hex()
    return f"""(SELECT ih AS id_hash, ch AS content_hash, unhex(sha256(unhex('03') || ih || ch)) AS fp{more} FROM
  (SELECT unhex(sha256(unhex('{s}01') || {fields_sql(policy.identity)})) AS ih, unhex(sha256(unhex('{s}02') || {fields_sql(sorted(policy.effective))})) AS ch{more} FROM {rows}))"""


def fingerprint_sql(rows: str, policy: Policy) -> str:
    return f"SELECT lower(hex(id_hash)) AS id_hash, lower(hex(content_hash)) AS content_hash, lower(hex(fp)) AS fp FROM {fp_sql(rows, policy)}"


for _name, _table, _policy in (("fingerprint_orders", "orders", ORDERS), ("fingerprint_lineitem", "lineitem", LINES), ("fingerprint_events", "events", EVENTS)):
    QUERIES[_name] = lambda spark, sf, t=_table, p=_policy: fingerprints(table(spark, sf, t), p, SALT).select(*hexa("id_hash", "content_hash", "fp"))
    ORACLE_SQL[_name] = fingerprint_sql(_table, _policy)

# --- faults and reconciliation ------------------------------------------------------------------

def K() -> Column:  # noqa: N802
    return F.col("o_orderkey")


_ALL_ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
FAULTS: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "clean": (lambda d: d, f"(SELECT {_ALL_ORDERS} FROM orders)"),
    "drop": (lambda d: faults.drop(d, K() % 97 == 0), f"(SELECT {_ALL_ORDERS} FROM orders WHERE o_orderkey % 97 <> 0)"),
    "dup": (lambda d: faults.duplicate(d, K() % 89 == 0), f"(SELECT {_ALL_ORDERS} FROM orders UNION ALL SELECT {_ALL_ORDERS} FROM orders WHERE o_orderkey % 89 = 0)"),
    "mutate": (lambda d: faults.mutate(d, K() % 83 == 0, "o_totalprice", F.col("o_totalprice") + 1), "(SELECT * REPLACE (CASE WHEN o_orderkey % 83 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice) FROM orders)"),
    "phantom": (lambda d: faults.phantom(d, K() % 101 == 0, "o_orderkey", -1 - K()), f"(SELECT {_ALL_ORDERS} FROM orders UNION ALL SELECT * REPLACE (-1 - o_orderkey AS o_orderkey) FROM orders WHERE o_orderkey % 101 = 0)"),
}
FAULTS["mixed"] = (
    lambda d: faults.phantom(faults.duplicate(faults.mutate(faults.drop(d, K() % 97 == 0), K() % 83 == 0, "o_totalprice", F.col("o_totalprice") + 1), K() % 89 == 0), K() % 101 == 0, "o_orderkey", -1 - K()),
    """(WITH m AS (SELECT * REPLACE (CASE WHEN o_orderkey % 83 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice) FROM orders WHERE o_orderkey % 97 <> 0),
  d AS (SELECT * FROM m UNION ALL SELECT * FROM m WHERE o_orderkey % 89 = 0)
  SELECT * FROM d UNION ALL SELECT * REPLACE (-1 - o_orderkey AS o_orderkey) FROM d WHERE o_orderkey % 101 = 0)""",
)


def orders_pair(spark: SparkSession, sf_dir: str, fault: str) -> Reconciliation:
    d = table(spark, sf_dir, "orders").withColumn("pos", K())
    return reconcile(fingerprints(d, ORDERS, SALT), fingerprints(FAULTS[fault][0](d), ORDERS, SALT))


def lines_pair(spark: SparkSession, sf_dir: str) -> Reconciliation:
    d = table(spark, sf_dir, "lineitem").withColumn("pos", F.struct(*LINE_ORDER))
    sink = faults.mutate(faults.drop(d, F.col("l_partkey") % 97 == 0), F.col("l_partkey") % 83 == 0, "l_quantity", F.col("l_quantity") + 1)
    return reconcile(fingerprints(d, LINES, SALT), fingerprints(sink, LINES, SALT))


LINE_SINK = "(SELECT * REPLACE (CASE WHEN l_partkey % 83 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity) , l_quantity AS oq FROM lineitem WHERE l_partkey % 97 <> 0)"


def classes_sql(source: str, sink: str, policy: Policy, order: str, sink_order: str | None = None) -> str:
    """CTEs that end in z: side, id_hash, content_hash, fp, pos, class, other."""
    return f"""WITH b AS (SELECT 'source' AS side, id_hash, content_hash, fp, pos FROM {fp_sql(f'(SELECT *, {order} AS pos FROM {source})', policy, 'pos')}
  UNION ALL SELECT 'sink', id_hash, content_hash, fp, pos FROM {fp_sql(f'(SELECT *, {sink_order or order} AS pos FROM {sink})', policy, 'pos')}),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id_hash, content_hash, side ORDER BY pos) AS rn,
  least(count(*) FILTER (WHERE side = 'source') OVER (PARTITION BY id_hash, content_hash), count(*) FILTER (WHERE side = 'sink') OVER (PARTITION BY id_hash, content_hash)) AS m FROM b),
l AS (SELECT *, rn > m AS rest, row_number() OVER (PARTITION BY id_hash, side, rn > m ORDER BY pos, content_hash) AS lrn FROM r),
o AS (SELECT *, max(content_hash) FILTER (WHERE side = 'sink') OVER (PARTITION BY id_hash, rest, lrn) AS kc, max(content_hash) FILTER (WHERE side = 'source') OVER (PARTITION BY id_hash, rest, lrn) AS sc FROM l),
z AS MATERIALIZED (SELECT side, id_hash, content_hash, fp, pos, CASE WHEN rest THEN CASE side WHEN 'source' THEN kc ELSE sc END END AS other,
  CASE WHEN NOT rest THEN 'matched' WHEN sc IS NOT NULL AND kc IS NOT NULL THEN 'mutated' WHEN side = 'source' THEN 'missing' ELSE 'extra' END AS class FROM o),
g AS (SELECT id_hash, count(*) FILTER (WHERE side = 'source') AS s, count(*) FILTER (WHERE side = 'sink') AS k FROM b GROUP BY id_hash)
"""


SUMMARY_SQL = """SELECT CAST((SELECT coalesce(sum(s), 0) FROM g) AS BIGINT) AS source_count, CAST((SELECT coalesce(sum(k), 0) FROM g) AS BIGINT) AS sink_count,
  (SELECT count(*) FROM z WHERE side = 'source' AND class = 'matched') AS matched, (SELECT count(*) FROM z WHERE side = 'source' AND class = 'missing') AS missing,
  (SELECT count(*) FROM z WHERE side = 'source' AND class = 'mutated') AS mutated_copies,
  (SELECT count(*) FROM (SELECT DISTINCT id_hash, content_hash, other FROM z WHERE side = 'source' AND class = 'mutated')) AS mutated,
  (SELECT count(*) FROM g WHERE k > s) AS duplicated, CAST((SELECT coalesce(sum(greatest(k - s, 0)), 0) FROM g) AS BIGINT) AS duplicate_excess, (SELECT count(*) FROM g WHERE s = 0) AS phantoms"""


def _verdict_sql(inner: str, t: Tolerances) -> str:
    dup = "OR duplicated > 0" if t.duplicates is DuplicatePolicy.FORBID else ""
    return f"CASE WHEN missing > {t.max_drops} OR mutated > {t.max_mutations} {dup} THEN 'FAIL' ELSE 'PASS' END"


for _fault, (_, _sql) in FAULTS.items():
    QUERIES[f"reconcile_{_fault}"] = lambda spark, sf, f=_fault: (s := orders_pair(spark, sf, f).summary()).withColumn("verdict", verdict_of(s))
    ORACLE_SQL[f"reconcile_{_fault}"] = f"{classes_sql('orders', _sql, ORDERS, 'o_orderkey')}, y AS ({SUMMARY_SQL}) SELECT *, {_verdict_sql('y', Tolerances())} AS verdict FROM y"

_MIXED_SQL = classes_sql("orders", FAULTS["mixed"][1], ORDERS, "o_orderkey")
_LINE_POS = "struct_pack(a := l_partkey, b := l_suppkey, c := l_quantity, d := l_extendedprice, e := l_discount, f := l_tax)"
_LINES_SQL = classes_sql("lineitem", LINE_SINK, LINES, _LINE_POS)


@query(f"{_LINES_SQL}, y AS ({SUMMARY_SQL}) SELECT *, {_verdict_sql('y', Tolerances())} AS verdict FROM y")
def reconcile_lineitem_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lines_pair(spark, sf_dir).summary()
    return s.withColumn("verdict", verdict_of(s))


@query(f"{_LINES_SQL} SELECT lower(hex(id_hash)) AS id_hash, lower(hex(content_hash)) AS content_hash FROM z WHERE side = 'source' AND class = 'missing'")
def evidence_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_pair(spark, sf_dir).missing.select(*hexa("id_hash", "content_hash"))


@query(f"{_MIXED_SQL} SELECT lower(hex(id_hash)) AS id_hash, s AS source_multiplicity, k AS sink_multiplicity, s = 0 AS is_phantom FROM g WHERE k > s")
def evidence_duplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_pair(spark, sf_dir, "mixed").duplicated.select(*hexa("id_hash"), "source_multiplicity", "sink_multiplicity", "is_phantom")


@query(f"{_LINES_SQL} SELECT DISTINCT lower(hex(id_hash)) AS id_hash, lower(hex(content_hash)) AS source_content_hash, lower(hex(other)) AS sink_content_hash FROM z WHERE side = 'source' AND class = 'mutated'")
def evidence_mutated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_pair(spark, sf_dir).mutated.select(*hexa("id_hash", "source_content_hash", "sink_content_hash"))


@query(f"{_MIXED_SQL} SELECT lower(hex(fp)) AS fp, CAST(pos AS BIGINT) AS pos FROM z WHERE side = 'source' AND class = 'matched'")
def matched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_pair(spark, sf_dir, "mixed").matched.select(*hexa("fp"), "pos")


_IDS = "l_orderkey, l_linenumber, l_partkey"


@query(f"SELECT {_IDS} FROM lineitem INTERSECT ALL SELECT {_IDS} FROM {LINE_SINK}")
def multiset_intersect_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return multiset_intersect(d, d.where("l_partkey % 97 != 0"))


@query(f"SELECT {_IDS} FROM lineitem EXCEPT ALL SELECT {_IDS} FROM {LINE_SINK}")
def multiset_except_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return multiset_except(d, d.where("l_partkey % 97 != 0"))


_MATRIX = [("strict", Tolerances()), ("idempotent", Tolerances(duplicates=DuplicatePolicy.ALLOW_IF_SINK_IDEMPOTENT)), ("loose", Tolerances(10_000_000, DuplicatePolicy.ALLOW_IF_SINK_IDEMPOTENT, 10_000_000))]


@query(" UNION ALL ".join(f"SELECT '{f}' AS fault, '{n}' AS policy, verdict FROM ({classes_sql('orders', sql, ORDERS, 'o_orderkey')}, y AS ({SUMMARY_SQL}) SELECT {_verdict_sql('y', t)} AS verdict FROM y)" for f, (_, sql) in FAULTS.items() for n, t in _MATRIX) + " UNION ALL SELECT 'clean', 'unread', 'UNVERIFIED'")
def verdict_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for f in FAULTS:
        s = orders_pair(spark, sf_dir, f).summary()
        row = s.select(F.lit(f).alias("fault"), F.explode(F.array(*(F.struct(F.lit(n).alias("policy"), verdict_of(s, t).alias("verdict")) for n, t in _MATRIX), *([F.struct(F.lit("unread").alias("policy"), verdict_of(s, reason="the source was not read to its end").alias("verdict"))] if f == "clean" else []))).alias("v")).select("fault", "v.*")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"{_LINES_SQL}, y AS ({SUMMARY_SQL}), v AS (SELECT *, {_verdict_sql('y', Tolerances())} AS verdict FROM y) SELECT matched + missing + mutated_copies = source_count AND matched + mutated_copies <= sink_count AS balanced, verdict <> 'PASS' OR (source_count = sink_count AND missing = 0) AS honest FROM v")
def commitment_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lines_pair(spark, sf_dir).summary()
    return s.withColumn("verdict", verdict_of(s)).select(balanced().alias("balanced"), honest().alias("honest"))


# --- digests of ranges, several hops, declared transforms ----------------------------------------

#: A few faults of each kind.
_FEW = (
    lambda d: faults.duplicate(faults.mutate(faults.drop(d, K() % 1009 == 5), K() % 1013 == 7, "o_totalprice", F.col("o_totalprice") + 1), K() % 1019 == 11),
    """(WITH m AS (SELECT * REPLACE (CASE WHEN o_orderkey % 1013 = 7 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice) FROM orders WHERE o_orderkey % 1009 <> 5)
  SELECT * FROM m UNION ALL SELECT * FROM m WHERE o_orderkey % 1019 = 11)""",
)
_FEW_SQL = classes_sql("orders", _FEW[1], ORDERS, "o_orderkey")


def _prefiltered(spark: SparkSession, sf_dir: str, fault: Callable[[DataFrame], DataFrame]):
    d = table(spark, sf_dir, "orders").withColumn("pos", K())
    return prefilter(fingerprints(d, ORDERS, SALT), fingerprints(fault(d), ORDERS, SALT))


for _name, _fault, _sql in (("prefilter_few", _FEW[0], _FEW_SQL), ("prefilter_mixed", FAULTS["mixed"][0], _MIXED_SQL), ("prefilter_clean", FAULTS["clean"][0], classes_sql("orders", FAULTS["clean"][1], ORDERS, "o_orderkey"))):
    QUERIES[_name] = lambda spark, sf, f=_fault: (s := _prefiltered(spark, sf, f).summary()).withColumn("verdict", verdict_of(s))
    ORACLE_SQL[_name] = f"{_sql}, y AS ({SUMMARY_SQL}) SELECT *, {_verdict_sql('y', Tolerances())} AS verdict FROM y"


@query(f"{_FEW_SQL} SELECT lower(hex(id_hash)) AS id_hash, lower(hex(content_hash)) AS content_hash, CAST(pos AS BIGINT) AS pos FROM z WHERE side = 'source' AND class = 'missing'")
def prefilter_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prefiltered(spark, sf_dir, _FEW[0]).missing.select(*hexa("id_hash", "content_hash"), "pos")


def _level_sql(level: int, bits: int, rows: str) -> str:
    return f"""SELECT {level} AS level, count(*) AS ranges, count(*) FILTER (WHERE differs) AS differing, CAST(coalesce(sum(s) FILTER (WHERE differs), 0) AS BIGINT) AS source_rows, CAST(coalesce(sum(k) FILTER (WHERE differs), 0) AS BIGINT) AS sink_rows
  FROM (SELECT r, sum(s) AS s, sum(k) AS k, bool_or(s <> k) AS differs FROM (SELECT CAST('0x' || substr(hex(id_hash), 1, 8) AS BIGINT) >> {32 - bits} AS r, count(*) FILTER (WHERE side = 'source') AS s, count(*) FILTER (WHERE side = 'sink') AS k FROM {rows} GROUP BY id_hash, content_hash) GROUP BY r)"""


@query(f"""{_FEW_SQL}, bad AS (SELECT DISTINCT CAST('0x' || substr(hex(id_hash), 1, 8) AS BIGINT) >> 22 AS r FROM (SELECT id_hash FROM b GROUP BY id_hash, content_hash HAVING count(*) FILTER (WHERE side = 'source') <> count(*) FILTER (WHERE side = 'sink')))
{_level_sql(1, 10, "b")} UNION ALL {_level_sql(2, 18, "(SELECT * FROM b WHERE CAST('0x' || substr(hex(id_hash), 1, 8) AS BIGINT) >> 22 IN (SELECT r FROM bad))")}""")
def prefilter_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ranges differ on each level, and the rows in them."""
    return _prefiltered(spark, sf_dir, _FEW[0]).levels


_HOP_SQL = ["orders", FAULTS["drop"][1], "(SELECT * REPLACE (CASE WHEN o_orderkey % 83 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice) FROM orders WHERE o_orderkey % 97 <> 0)"]
_HOP_SQL.append(f"(SELECT * FROM {_HOP_SQL[2]} UNION ALL SELECT * FROM {_HOP_SQL[2]} WHERE o_orderkey % 89 = 0 UNION ALL SELECT {_ALL_ORDERS} FROM orders WHERE o_orderkey % 970 = 0)")


def _hops(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Orders lose some on the first hop and change some on the second; on the third some come twice, and some of the lost come back."""
    d = table(spark, sf_dir, "orders")
    one = faults.drop(d, K() % 97 == 0)
    two = faults.mutate(one, K() % 83 == 0, "o_totalprice", F.col("o_totalprice") + 1)
    three = faults.duplicate(two, K() % 89 == 0).unionByName(d.where(K() % 970 == 0))
    return [fingerprints(x, ORDERS, SALT) for x in (d, one, two, three)]


_HOPS_SQL = "WITH h AS (" + " UNION ALL ".join(f"SELECT {i} AS hop, id_hash, content_hash FROM {fp_sql(x, ORDERS)}" for i, x in enumerate(_HOP_SQL)) + """),
c AS (SELECT id_hash, content_hash, count(*) FILTER (WHERE hop = 0) AS n0, count(*) FILTER (WHERE hop = 1) AS n1, count(*) FILTER (WHERE hop = 2) AS n2, count(*) FILTER (WHERE hop = 3) AS n3 FROM h GROUP BY id_hash, content_hash),
i AS (""" + " UNION ALL ".join(f"SELECT id_hash, {j} AS hop, sum(greatest(n{j - 1} - n{j}, 0)) AS gone, sum(greatest(n{j} - n{j - 1}, 0)) AS new FROM c GROUP BY id_hash" for j in (1, 2, 3)) + """),
u AS (SELECT id_hash, hop, CAST(greatest(gone - new, 0) AS BIGINT) AS lost, CAST(least(gone, new) AS BIGINT) AS changed, CAST(greatest(new - gone, 0) AS BIGINT) AS added FROM i WHERE gone + new > 0),
f AS (SELECT *, hop = min(hop) OVER (PARTITION BY id_hash) AS first FROM u)
"""


@query(f"{_HOPS_SQL} SELECT lower(hex(id_hash)) AS id_hash, hop, lost, changed, added, first FROM f")
def hop_faults_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hop_faults(_hops(spark, sf_dir)).select(*hexa("id_hash"), "hop", "lost", "changed", "added", "first")


@query(f"""{_HOPS_SQL}, r AS (SELECT hop, count(*) AS n FROM h GROUP BY hop)
SELECT b.hop, a.n AS rows_before, b.n AS rows_after, CAST(coalesce(sum(lost), 0) AS BIGINT) AS lost, CAST(coalesce(sum(changed), 0) AS BIGINT) AS changed, CAST(coalesce(sum(added), 0) AS BIGINT) AS added, count(*) FILTER (WHERE first) AS identities
FROM r b JOIN r a ON a.hop = b.hop - 1 LEFT JOIN f ON f.hop = b.hop GROUP BY b.hop, a.n, b.n""")
def hop_summary_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hop_summary(_hops(spark, sf_dir))


#: Lines as one record for each order.
ORDER_TOTALS = Transform({"order_key": "l_orderkey"}, "l_linenumber > 0", ("order_key",), {"line_count": ("count", "l_linenumber"), "quantity": ("sum", "l_quantity"), "price": ("sum", "l_extendedprice * (1 - l_discount)"), "last_ship": ("max", "l_shipdate")})
TOTALS = Policy("field:order_key", ("order_key", "line_count", "quantity", "price", "last_ship"))


def _totals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Reconciliation]:
    """A job's table of sums that has lost some orders, left a line out of some, and written some twice."""
    d = table(spark, sf_dir, "lineitem")
    kept = d.where("not (l_orderkey % 83 = 0 and l_linenumber = 1)")
    sums = kept.groupBy(F.col("l_orderkey").alias("order_key")).agg(F.count("*").alias("line_count"), F.sum(F.col("l_quantity").cast("decimal(28,6)")).alias("quantity"), F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(28,6)")).alias("price"), F.max("l_shipdate").alias("last_ship"))
    key = F.col("order_key")
    return d, reconcile_transformed(d, faults.duplicate(faults.drop(sums, key % 97 == 0), key % 89 == 0), ORDER_TOTALS, TOTALS, SALT)


def _money(x: str) -> str:
    return f"sum(CAST({x} AS DECIMAL(28, 6)))"


def _totals_sql(rows: str) -> str:
    return f"(SELECT l_orderkey AS order_key, count(*) AS line_count, {_money('l_quantity')} AS quantity, {_money('l_extendedprice * (1 - l_discount)')} AS price, max(l_shipdate) AS last_ship FROM {rows} GROUP BY l_orderkey)"


_TOTALS_SINK = _totals_sql("(SELECT * FROM lineitem WHERE NOT (l_orderkey % 83 = 0 AND l_linenumber = 1))")
_TOTALS_SINK = f"(SELECT * FROM {_TOTALS_SINK} WHERE order_key % 97 <> 0 UNION ALL SELECT * FROM {_TOTALS_SINK} WHERE order_key % 97 <> 0 AND order_key % 89 = 0)"
KINDS |= {"price": "decimal", "quantity": "decimal", "last_ship": "timestamp"}
KIND_SQL["decimal"] = lambda c: text_sql("A3", f"CAST({c} AS VARCHAR)")
_TOTALS_CTE = classes_sql(_totals_sql("lineitem"), _TOTALS_SINK, TOTALS, "order_key")


@query(f"{_TOTALS_CTE}, y AS ({SUMMARY_SQL}) SELECT *, {_verdict_sql('y', Tolerances())} AS verdict FROM y")
def transform_order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _totals(spark, sf_dir)[1].summary()
    return s.withColumn("verdict", verdict_of(s))


@query("""WITH o AS (SELECT l_orderkey, CASE WHEN l_orderkey % 97 = 0 OR (l_orderkey % 83 = 0 AND bool_and(l_linenumber = 1)) THEN 'missing' WHEN l_orderkey % 83 = 0 AND bool_or(l_linenumber = 1) THEN 'mutated' END AS kind FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, l_linenumber, kind FROM lineitem JOIN o USING (l_orderkey) WHERE kind IS NOT NULL""")
def transform_contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines behind each order's sum that is missing or has changed."""
    d, r = _totals(spark, sf_dir)
    of = lambda records, kind: ORDER_TOTALS.contributors(d, records, TOTALS, SALT).select("l_orderkey", "l_linenumber", F.lit(kind).alias("kind"))
    return of(r.missing, "missing").unionByName(of(r.mutated, "mutated"))


# --- streams, gaps, chains ------------------------------------------------------------------------

_EVENT_SINK = """(WITH m AS (SELECT * REPLACE (CASE WHEN event_id % 83 = 0 THEN value + 1 ELSE value END AS value) FROM events WHERE event_id % 97 <> 0)
  SELECT * FROM m UNION ALL SELECT * FROM m WHERE event_id % 89 = 0)"""


@query(f"""WITH h AS (SELECT id_hash, content_hash, 1 AS s, 0 AS k, epoch_us(ts) // 1000 AS ms FROM {fp_sql('events', EVENTS, 'ts')} UNION ALL SELECT id_hash, content_hash, 0, 1, epoch_us(ts) // 1000 FROM {fp_sql(_EVENT_SINK, EVENTS, 'ts')}),
c AS (SELECT id_hash, content_hash, sum(s) AS s, sum(k) AS k, max(ms) AS ms FROM h GROUP BY id_hash, content_hash),
i AS (SELECT id_hash, sum(s) AS s, sum(k) AS k, sum(least(s, k)) AS m, max(ms) + 900000 AS closes FROM c GROUP BY id_hash)
SELECT lower(hex(id_hash)) AS id_hash, CAST(s AS BIGINT) AS source_multiplicity, CAST(k AS BIGINT) AS sink_multiplicity, CAST(m AS BIGINT) AS matched, CAST(least(s, k) - m AS BIGINT) AS mutated_copies, CAST(greatest(s - k, 0) AS BIGINT) AS missing, CAST(closes AS BIGINT) AS closed_ms
FROM i WHERE closes < (SELECT least(max(ms) FILTER (WHERE s = 1), max(ms) FILTER (WHERE k = 1)) FROM h)""")
def continuous_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream against a sink's stream: what is known of each identity whose window has closed when both streams end."""
    events = table(spark, sf_dir, "events")
    kind, buckets = events.schema, buckets_for(events.count())
    stream = lambda: spark.readStream.schema(kind).parquet(f"{sf_dir}/[e]vents.parquet")
    at = F.col("event_id")
    sink = faults.mutate(faults.drop(stream(), at % 97 == 0), at % 83 == 0, "value", F.col("value") + 1)
    sink = sink.withColumn("twice", F.explode(F.when(at % 89 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("twice")
    out = scratch(spark, "continuous")
    run_continuous(continuous(stream(), sink, EVENTS, SALT, buckets=buckets), out, scratch(spark, "continuous-checkpoint")).awaitTermination()
    from ..streaming.continuous import RESULT

    return spark.read.schema(RESULT).parquet(out).withColumn("id_hash", F.lower(F.hex("id_hash")))


_GAP_BOUNDARY = Boundary.of("OFFSET_RANGE", {"partitions": [{"id": 0, "start": 0, "end": 60000}, {"id": 1, "start": 10, "end": 2000}, {"id": 2, "start": 0, "end": 20}, {"id": 7, "start": 5, "end": 9}]})
_GAP_WANT = "(VALUES (0, 0, 60000), (1, 10, 2000), (2, 0, 20), (7, 5, 9)) w(p, a, z)"
_GAP_SQL = f"""WITH w AS (SELECT * FROM {_GAP_WANT}), x AS (SELECT DISTINCT event_id % 4 AS p, event_id // 4 AS o FROM events WHERE (event_id // 4) % 500 NOT BETWEEN 100 AND 103 AND (event_id // 4) % 711 <> 7),
s AS (SELECT w.p, o FROM x JOIN w ON x.p = w.p AND o BETWEEN a AND z UNION ALL SELECT p, a - 1 FROM w UNION ALL SELECT p, z + 1 FROM w),
g AS (SELECT p, o + 1 AS f, lead(o) OVER (PARTITION BY p ORDER BY o) - 1 AS l FROM s)"""


def _gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of four partitions that has lost some offsets."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 4).alias("partition"), F.floor(F.col("event_id") / 4).alias("offset"))
    return e.where("offset % 500 not between 100 and 103 and offset % 711 != 7")


@query(f"{_GAP_SQL} SELECT CAST(p AS BIGINT) AS partition, CAST(f AS BIGINT) AS first, CAST(l AS BIGINT) AS last FROM g WHERE f <= l")
def boundary_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offset_gaps(_gapped(spark, sf_dir), _GAP_BOUNDARY)


@query(f"""{_GAP_SQL}, n AS (SELECT p, sum(l - f + 1) AS m, count(*) AS c FROM g WHERE f <= l GROUP BY p)
SELECT CAST(w.p AS BIGINT) AS partition, CAST(a AS BIGINT) AS start, CAST(z AS BIGINT) AS "end", CAST(coalesce(m, 0) AS BIGINT) AS missing, coalesce(c, 0) AS gaps, CASE WHEN c > 0 THEN 'UNVERIFIED' END AS verdict FROM w LEFT JOIN n USING (p)""")
def boundary_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completeness(_gapped(spark, sf_dir), _GAP_BOUNDARY)


_LOG_SQL = "SELECT event_id % 4 AS p, event_id // 4 AS o, event_type AS v FROM events WHERE (event_id // 4) % 500 NOT BETWEEN 100 AND 103 AND (event_id // 4) % 711 <> 7"


def _segments(spark: SparkSession, sf_dir: str) -> str:
    """The log of _gapped, with the kinds of its events as values, in segments of 1,000 offsets."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 4).alias("partition"), F.floor(F.col("event_id") / 4).alias("offset"), F.col("event_type").alias("value"))
    path = scratch(spark, "segments")
    write_segments(e.where("offset % 500 not between 100 and 103 and offset % 711 != 7"), path, segment=1000)
    return path


@query(f"SELECT CAST(x.p AS BIGINT) AS partition, CAST(o AS BIGINT) AS \"offset\", v AS value FROM ({_LOG_SQL}) x JOIN {_GAP_WANT} ON x.p = w.p AND o BETWEEN a AND z WHERE o >= 15 AND x.p <> 2")
def segments_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a boundary, read by ranges of offsets; conditions on partition and offset decide the ranges as well."""
    log = read_segments(spark, _segments(spark, sf_dir), _GAP_BOUNDARY, segment=1000)
    return log.where("offset >= 15 and partition in (0, 1, 3, 7)").select("partition", "offset", F.col("value").cast("string").alias("value"))


@query(f"SELECT CAST(p AS BIGINT) AS partition, v AS value, count(*) AS n, CAST(min(o) AS BIGINT) AS first, CAST(max(o) AS BIGINT) AS last FROM ({_LOG_SQL}) GROUP BY p, v")
def segments_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log as a stream, with its offsets as the position, written as a table and counted."""
    out = scratch(spark, "segments-out")
    log = read_segments(spark, _segments(spark, sf_dir), segment=1000, stream=True)
    log.writeStream.format("parquet").option("checkpointLocation", scratch(spark, "segments-checkpoint")).trigger(availableNow=True).start(out).awaitTermination()
    rows = spark.read.schema("partition long, offset long, value binary").parquet(out)
    return rows.groupBy("partition", F.col("value").cast("string").alias("value")).agg(F.count("*").alias("n"), F.min("offset").alias("first"), F.max("offset").alias("last"))


_LINK_SQL = """SELECT DISTINCT 'p' || o_orderkey AS id, CASE WHEN o_orderkey % 200 = 0 THEN NULL WHEN o_orderkey % 331 = 0 THEN 'lost' || o_orderkey WHEN o_orderkey % 200 = 77 THEN 'p' || (o_orderkey - 2) ELSE 'p' || (o_orderkey - 1) END AS prev FROM orders"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link for each order: chains of 200, some with a fork or without the link before."""
    k = lambda d: F.concat(F.lit("p"), (K() - d).cast("string"))
    prev = F.when(K() % 200 == 0, None).when(K() % 331 == 0, F.concat(F.lit("lost"), K().cast("string"))).when(K() % 200 == 77, k(2)).otherwise(k(1))
    return table(spark, sf_dir, "orders").select(k(0).alias("proof_id"), prev.alias("prev_proof_hash"))


@query(f"""WITH RECURSIVE l AS ({_LINK_SQL}), b AS (SELECT l.*, CASE WHEN l.prev IS NULL THEN 'start' WHEN EXISTS (SELECT 1 FROM l o WHERE o.id = l.prev) THEN 'linked' ELSE 'gap' END AS state, (SELECT count(*) FROM l o WHERE o.prev = l.id) AS successors FROM l),
t(id, root, depth) AS (SELECT id, id, CAST(0 AS BIGINT) FROM b WHERE state <> 'linked' UNION ALL SELECT b.id, t.root, t.depth + 1 FROM b JOIN t ON b.prev = t.id)
SELECT b.id, prev, root, depth, CASE WHEN root IS NULL THEN 'cycle' ELSE state END AS state, successors, root IS NOT NULL AND successors = 0 AS head FROM b LEFT JOIN t USING (id)""")
def supersede_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_links(_links(spark, sf_dir))


# --- commitments --------------------------------------------------------------------------------


def root_sql(fps: str) -> str:
    return f"""WITH RECURSIVE f AS ({fps}), t(level, i, h, n) AS (
  SELECT 0, row_number() OVER (ORDER BY unhex(sha256(unhex('00') || fp))) - 1, unhex(sha256(unhex('00') || fp)), count(*) OVER () FROM f
  UNION ALL SELECT any_value(level) + 1, i // 2, unhex(sha256(unhex('10') || arg_min(h, i) || arg_max(h, i))), (any_value(n) + 1) // 2 FROM t WHERE n > 1 GROUP BY i // 2)
SELECT (SELECT count(*) FROM f) AS count, lower(hex(h)) AS merkle_root FROM t WHERE n = 1"""


_SOURCE_FP = f"SELECT fp FROM {fp_sql('orders', ORDERS)}"
_SINK_FP = f"SELECT fp FROM {fp_sql(FAULTS['mixed'][1], ORDERS)}"


@query(root_sql(_SOURCE_FP))
def merkle_root_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_root(fingerprints(table(spark, sf_dir, "orders"), ORDERS, SALT)).select("count", *hexa("merkle_root"))


@query(root_sql(_SINK_FP))
def merkle_root_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_root(fingerprints(FAULTS["mixed"][0](table(spark, sf_dir, "orders")), ORDERS, SALT)).select("count", *hexa("merkle_root"))


@query(root_sql(f"SELECT fp FROM ({_MIXED_SQL} SELECT fp FROM z WHERE side = 'source' AND class = 'matched')"))
def merkle_root_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_root(orders_pair(spark, sf_dir, "mixed").matched_fingerprints, weight="copies").select("count", *hexa("merkle_root"))


_PROOF_SQL = f"""WITH RECURSIVE f AS ({_SOURCE_FP}), t(level, i, h, n) AS (
  SELECT 0, row_number() OVER (ORDER BY unhex(sha256(unhex('00') || fp))) - 1, unhex(sha256(unhex('00') || fp)), count(*) OVER () FROM f
  UNION ALL SELECT any_value(level) + 1, i // 2, unhex(sha256(unhex('10') || arg_min(h, i) || arg_max(h, i))), (any_value(n) + 1) // 2 FROM t WHERE n > 1 GROUP BY i // 2),
w AS (SELECT DISTINCT t.i, t.h FROM (SELECT unhex(sha256(unhex('00') || fp)) AS h FROM {fp_sql('(SELECT * FROM orders WHERE o_orderkey % 97 = 0)', ORDERS)}) x JOIN t ON t.level = 0 AND t.h = x.h),
p AS (SELECT w.h AS leaf, w.i AS idx, s.level, s.h FROM w JOIN t s ON s.n > 1 AND s.i = least(xor(w.i // CAST(2 ** s.level AS BIGINT), 1), s.n - 1))
SELECT lower(hex(leaf)) AS leaf, CAST(idx AS BIGINT) AS idx, string_agg(lower(hex(h)), ',' ORDER BY level) AS proof FROM p GROUP BY leaf, idx"""


def _proofs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    fp = fingerprints(table(spark, sf_dir, "orders"), ORDERS, SALT)
    return fp, inclusion_proofs(fp, fingerprints(table(spark, sf_dir, "orders").where("o_orderkey % 97 = 0"), ORDERS, SALT))


@query(_PROOF_SQL)
def inclusion_proofs_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _proofs(spark, sf_dir)[1].select(*hexa("leaf"), "idx", F.array_join(F.transform("proof", lambda h: F.lower(F.hex(h))), ",").alias("proof"))


@query("SELECT count(*) AS proofs, count(*) AS verified, CAST(0 AS BIGINT) AS wrong_place FROM orders WHERE o_orderkey % 97 = 0")
def inclusion_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    fp, proofs = _proofs(spark, sf_dir)
    root = merkle_root(fp).select("merkle_root")
    j = proofs.join(F.broadcast(root))  # one row
    good = verified_inclusion(F.col("leaf"), F.col("idx"), F.col("proof"), F.col("merkle_root"))
    moved = verified_inclusion(F.col("leaf"), F.col("idx").bitwiseXOR(F.lit(1).cast("long")), F.col("proof"), F.col("merkle_root"))
    return j.agg(F.count("*").alias("proofs"), F.count_if(good).alias("verified"), F.count_if(moved).alias("wrong_place"))


_WORDS_SQL = " || ".join(f"unhex(printf('%08x', bit_xor(CAST('0x' || substr(hex(fp), {8 * i + 1}, 8) AS BIGINT))))" for i in range(8))


@query(f"SELECT sha256(unhex('20') || w) AS commutative_root FROM (SELECT {_WORDS_SQL} AS w FROM ({_SOURCE_FP}))")
def commutative_root_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commutative_root(fingerprints(table(spark, sf_dir, "orders"), ORDERS, SALT)).select(*hexa("commutative_root"))


_LOG_FP = f"(SELECT fp, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM {fp_sql('orders', ORDERS, 'o_orderkey')})"


@query(f"""WITH RECURSIVE t(level, i, h) AS (SELECT 0, i, unhex(sha256(unhex('00') || fp)) FROM {_LOG_FP}
  UNION ALL SELECT any_value(level) + 1, i // 2, unhex(sha256(unhex('10') || arg_min(h, i) || arg_max(h, i))) FROM t GROUP BY i // 2 HAVING count(*) = 2),
n AS (SELECT count(*) AS n FROM orders), z AS (SELECT n // 3 AS a, 2 * n // 3 AS b FROM n UNION ALL SELECT 2 * n // 3, n FROM n),
w AS (SELECT a, b, 'old' AS part, 0 AS lo, a AS hi FROM z UNION ALL SELECT a, b, 'new', a, b FROM z),
k AS (SELECT *, CAST(2 ** level AS BIGINT) AS width FROM t)
SELECT CAST(a AS BIGINT) AS old_size, CAST(b AS BIGINT) AS new_size, part, level, CAST(i AS BIGINT) AS idx, lower(hex(h)) AS hash FROM w JOIN k ON i * width >= lo AND (i + 1) * width <= hi
WHERE NOT ((i // 2) * 2 * width >= lo AND (i // 2 + 1) * 2 * width <= hi)""")
def log_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a log in the order of their keys: proofs between its first third, two thirds and all of it."""
    d = table(spark, sf_dir, "orders").withColumn("pos_key", K())
    fp = fingerprints(d, ORDERS, SALT).select("fp", "pos_key")
    idx = _places(fp, "pos_key")
    n = d.count()
    return consistency_proofs(log_levels(idx, n), [n // 3, 2 * n // 3, n]).withColumn("hash", F.lower(F.hex("hash")))


def _places(rows: DataFrame, key: str) -> DataFrame:
    """rows with idx, their place by a distinct key, counted by stretches of 65,536 keys."""
    part = F.shiftright(key, 16)
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each stretch
    x = rows.withColumn("part", part).join(sizes.select("part", before.alias("before")), "part")
    return x.withColumn("idx", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1).drop("part", "before")


# --- canonical form -----------------------------------------------------------------------------


@query(f"SELECT o_orderkey, lower(hex({' || '.join(KIND_SQL[k](e) for k, e in (('int', 'nullif(o_custkey % 7, 0)'), ('string', 'o_orderstatus'), ('double', '-o_totalprice'), ('timestamp', 'o_orderdate'), ('bool', 'o_orderkey % 2 = 0')))})) AS canon FROM orders")
def canon_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.canon import encode_value

    x = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey") % 7).alias("i"), "o_orderstatus", (-F.col("o_totalprice")).alias("d"), "o_orderdate", (K() % 2 == 0).alias("b"))
    kinds = {f.name: f.dataType for f in x.schema.fields}
    return x.select("o_orderkey", F.lower(F.hex(F.concat(*(encode_value(F.col(c), kinds[c], CanonSpec()) for c in ("i", "o_orderstatus", "d", "o_orderdate", "b"))))).alias("canon"))


def _array_sql(inner: str) -> str:
    return f"SELECT user_id, lower(hex(unhex('F00000000178') || unhex('A5') || {u32_sql('len(x)')} || list_reduce({inner}, lambda a, b: a || b))) AS canon FROM (SELECT user_id, list({text_sql('A2', 'event_type')} ORDER BY event_id) AS x FROM events WHERE event_type IS NOT NULL GROUP BY user_id)"


def _arrays(spark: SparkSession, sf_dir: str, as_set: bool) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type is not null").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda s: s.event_type).alias("x"))
    return e.select("user_id", F.lower(F.hex(encode_fields(e, ["x"], CanonSpec(array_as_set=as_set)))).alias("canon"))


@query(_array_sql("x"))
def canon_array_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arrays(spark, sf_dir, False)


@query(_array_sql("list_sort(x)"))
def canon_array_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arrays(spark, sf_dir, True)


@query(f"SELECT doc_id, sha256({text_sql('A2', 'nfc_normalize(text)')}) AS canon_sha256 FROM documents")
def canon_nfc_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import types as T

    from ..functions.canon import encode_value

    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(encode_value(F.col("text"), T.StringType(), CanonSpec()), 256).alias("canon_sha256"))


_ACCENT = "chr(101) || chr(769)"


@query(f"SELECT doc_id, lower(hex(unhex('F00000000178A500000002') || {text_sql('A2', f'nfc_normalize(source || {_ACCENT})')} || {text_sql('A2', 'nfc_normalize(lang)')})) AS canon FROM documents")
def canon_nfc_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays whose first string has a letter and an accent of its own."""
    x = table(spark, sf_dir, "documents").select("doc_id", F.array(F.concat("source", F.lit("e\u0301")), F.col("lang")).alias("x"))
    return x.select("doc_id", F.lower(F.hex(encode_fields(x, ["x"], CanonSpec()))).alias("canon"))


# --- boundaries and scans -----------------------------------------------------------------------


@query("SELECT event_id, user_id FROM events WHERE (user_id % 4 = 0 AND event_id BETWEEN 10 AND 500) OR (user_id % 4 = 2 AND event_id BETWEEN 0 AND 90)")
def boundary_offset_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Boundary.of("OFFSET_RANGE", {"partitions": [{"id": 0, "start": 10, "end": 500}, {"id": 2, "start": 0, "end": 90}]})
    x = table(spark, sf_dir, "events").withColumn("partition", F.col("user_id") % 4)
    return x.where(offset_range(b, offset="event_id")).select("event_id", "user_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def boundary_time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Boundary.of("TIME_WINDOW", {"start": "1995-01-01T00:00:00", "end": "1996-01-01T00:00:00"})
    return table(spark, sf_dir, "orders").where(time_window(b, "o_orderdate")).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey BETWEEN 2 AND 5")
def boundary_snapshot_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Boundary.of("BATCH_ID", {"snapshot_from": 2, "snapshot_to": 5})
    return table(spark, sf_dir, "lineitem").where(snapshot_range(b, "l_suppkey")).select("l_orderkey", "l_linenumber")


def _log(spark: SparkSession, sf_dir: str) -> KafkaLog:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"), F.to_json(F.struct("event_id", "user_id", "event_type")).cast("binary").alias("value"))
    return KafkaLog(e, "event_id long, user_id long, event_type string")


_LOG_BOUNDARY = Boundary.of("OFFSET_RANGE", {"partitions": [{"id": 1, "start": 0, "end": 400}, {"id": 3, "start": 5, "end": 1000}]})
_LOG_SQL = "events WHERE (user_id % 4 = 1 AND event_id BETWEEN 0 AND 400) OR (user_id % 4 = 3 AND event_id BETWEEN 5 AND 1000)"


@query(f"SELECT event_id, user_id, event_type, '{{\"offset\":' || event_id || ',\"partition\":' || (user_id % 4) || '}}' AS pos_text FROM {_LOG_SQL}")
def kafka_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).rows(_LOG_BOUNDARY).select("event_id", "user_id", "event_type", "pos_text")


_LOG_POLICY = Policy("field:event_id", ("event_id", "user_id", "event_type"))


@query(fingerprint_sql(f"(SELECT * FROM {_LOG_SQL})", _LOG_POLICY))
def json_payload_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_log(spark, sf_dir).rows(_LOG_BOUNDARY), _LOG_POLICY, SALT).select(*hexa("id_hash", "content_hash", "fp"))


@query("SELECT o_orderkey, sha256(concat_ws('|', coalesce(CAST(o_orderkey AS VARCHAR), ''), coalesce(CAST(o_custkey AS VARCHAR), ''), coalesce(o_orderstatus, ''))) AS row_hash FROM orders WHERE o_custkey % 2 = 0")
def row_hash_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_hash(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"], "o_custkey % 2 = 0").select("o_orderkey", "row_hash")


@query("SELECT 'missing' AS kind, 'o_comment' AS field UNION ALL SELECT 'unexpected', unnest(['o_orderdate', 'o_orderpriority'])")
def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = check_schema_drift(["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_comment"], table(spark, sf_dir, "orders").columns)
    return spark.createDataFrame([("missing", f) for f in d.missing] + [("unexpected", f) for f in d.unexpected], "kind string, field string")


@query("SELECT o_orderkey, o_orderstatus, CAST(o_orderkey % 3 + 1 AS BIGINT) AS snapshot_id FROM orders WHERE o_orderkey % 3 IN (1, 2)")
def snapshot_manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a table of three snapshots, of which the last two are read."""
    t = SnapshotTable(spark, scratch(spark, "snapshots"), "orders")
    d = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    for i in (1, 2, 3):
        t.write_snapshot(d.where(K() % 3 == i - 1), i)
    return t.rows(Boundary.of("BATCH_ID", {"snapshot_from": 2, "snapshot_to": 3})).select("o_orderkey", "o_orderstatus", F.col("pos.a").alias("snapshot_id"))


# --- tables with a log --------------------------------------------------------------------------


def _delta_orders(spark: SparkSession, sf_dir: str) -> DeltaTable:
    """Orders as five versions: two are added, the first one's files are rewritten without some rows, a checkpoint, a third is added, a partition's files go."""
    t = DeltaTable(spark, scratch(spark, "delta"))
    d = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    # ranges of keys, so that statistics can tell files apart
    part = lambda i, and_=F.lit(True): d.where((K() % 4 == i) & and_).repartitionByRange(4, "o_orderkey")
    t.commit(part(0), partition_by=("o_orderstatus",))
    t.commit(part(1))
    t.commit(part(0, F.col("o_totalprice") < 200000), remove=t.files(0))
    t.checkpoint()
    t.commit(part(2))
    t.commit(remove=t.files(3, {"o_orderstatus": ("P", "P")}))
    return t


_DELTA_SQL = {
    0: "o_orderkey % 4 = 0",
    1: "o_orderkey % 4 IN (0, 1)",
    2: "(o_orderkey % 4 = 1 OR o_orderkey % 4 = 0 AND o_totalprice < 200000)",
    3: "(o_orderkey % 4 IN (1, 2) OR o_orderkey % 4 = 0 AND o_totalprice < 200000)",
    4: "(o_orderkey % 4 IN (1, 2) OR o_orderkey % 4 = 0 AND o_totalprice < 200000) AND o_orderstatus <> 'P'",
}


@query(" UNION ALL ".join(f"SELECT CAST({v} AS INTEGER) AS version, o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE {c}" for v, c in _DELTA_SQL.items()))
def delta_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of every version, before and after a checkpoint."""
    t = _delta_orders(spark, sf_dir)
    parts = [t.read(v).select(F.lit(v).alias("version"), "o_orderkey", "o_orderstatus", "o_totalprice") for v in _DELTA_SQL]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@query(f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE {_DELTA_SQL[4]} AND o_orderkey BETWEEN 1000 AND 3000 AND o_orderstatus = 'F'")
def delta_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last version in a range of keys and one partition; only files that can hold them are read."""
    return _delta_orders(spark, sf_dir).read(ranges={"o_orderkey": (1000, 3000), "o_orderstatus": ("F", "F")}).select("o_orderkey", "o_orderstatus", "o_totalprice")


# --- documents ----------------------------------------------------------------------------------

#: A key for tests only.
TEST_SEED = bytes(range(32))


class SeedSigner:
    def __init__(self, spark: SparkSession, seed: bytes = TEST_SEED):
        self.ed, self.seed = Ed25519(spark), seed

    def sign(self, message: bytes) -> bytes:
        return self.ed.sign(self.seed, message)


#: The public key of TEST_SEED.
TEST_PUBLIC = bytes.fromhex("03a107bff3ce10be1d70dd18e74bc09967e4d6309ba50d5f1ddc8664125531b8")


@query(f"{_MIXED_SQL}, y AS ({SUMMARY_SQL}) SELECT source_count, sink_count, matched, missing, mutated, duplicated, {_verdict_sql('y', Tolerances())} AS verdict, 'the document holds' AS verified FROM y")
def proof_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signed document about orders with every kind of fault, verified with its evidence, which is in tables where it is too much for a document."""
    d = table(spark, sf_dir, "orders").withColumn("pos", K())
    sides = fingerprints(d, ORDERS, SALT), fingerprints(FAULTS["mixed"][0](d), ORDERS, SALT)
    doc = build_document(*sides, ORDERS, SALT, Boundary.of("BATCH_ID", {"batch_id": 1}), SeedSigner(spark), TEST_PUBLIC, created_at="2000-01-01T00:00:00Z", tables=(tables := scratch(spark, "evidence")))
    r = doc["reconciliation"]
    n = evidence_counts(r)
    row = (doc["source_commitment"]["count"], doc["sink_commitment"]["count"], r["matched"]["count"], n["missing"], n["mutated"], n["duplicated"], r["verdict"], verify_with_tables(doc, TEST_PUBLIC, spark, tables)[1])
    return spark.createDataFrame([row], "source_count long, sink_count long, matched long, missing long, mutated long, duplicated long, verdict string, verified string")


@query("""SELECT 'doc-' || (c_custkey // 100) AS document, 'c_name' AS field, c_name AS value, CASE c_custkey % 250 WHEN 7 THEN 'plain' ELSE 'hex' END AS form FROM customer WHERE c_custkey % 250 IN (7, 9)""")
def evidence_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of customers in documents of their digests: some raw, some in hexadecimal; others only look like names."""
    c = table(spark, sf_dir, "customer")
    i = F.col("c_custkey") % 250
    note = F.when(i == 7, F.col("c_name")).when(i == 9, F.lower(F.hex("c_name"))).when(i == 11, F.concat("c_name", F.lit("0"))).when(i == 12, F.concat(F.lit("x"), "c_name"))
    rows = c.select(F.floor(F.col("c_custkey") / 100).alias("d"), F.to_json(F.struct(F.sha2("c_name", 256).alias("id_hash"), note.alias("note"))).alias("row"))
    docs = rows.groupBy("d").agg(F.concat_ws(",", F.sort_array(F.collect_list("row"))).alias("document")).select(F.concat(F.lit("doc-"), F.col("d").cast("string")).alias("path"), "document")
    return leaked_values(docs, c, ["c_name", "c_mktsegment"])


VECTORS = {"valid": "PASS", "tampered": "FAIL", "drop": "FAIL", "dup": "FAIL", "mutated": "FAIL"}


def vector_documents(spark: SparkSession, algorithm: str = "sha256", only: list[str] | None = None) -> dict[str, dict]:
    """Documents about five order records, one for each fault, and one with a damaged signature."""
    d = faults.sample_records(spark, 5)
    policy = Policy("composite:[line_id,order_id]", ("order_id", "line_id", "amount", "status"), ("_meta",), hash_algorithm=algorithm)
    at = F.col("pos")
    sinks = {"valid": d, "drop": faults.drop(d, at == 4), "dup": faults.duplicate(d, at == 2), "mutated": faults.mutate(d, at == 2, "amount", "dec:999.99")}
    boundary = Boundary.of("OFFSET_RANGE", {"partitions": [{"id": 0, "start": 0, "end": 4}]})
    out = {n: build_document(fingerprints(d, policy, SALT), fingerprints(x, policy, SALT), policy, SALT, boundary, SeedSigner(spark), TEST_PUBLIC, created_at="2000-01-01T00:00:00Z") for n, x in sinks.items() if only is None or n in only}
    if "valid" in out:
        damaged = bytearray(base64.b64decode(out["valid"]["signature"]["sig"]))
        damaged[20] ^= 1
        out["tampered"] = out["valid"] | {"signature": out["valid"]["signature"] | {"sig": base64.b64encode(damaged).decode()}}
    return out


@query(" UNION ALL ".join(f"SELECT '{n}' AS vector, '{o}' AS outcome, '{'bad signature' if n == 'tampered' else 'the document holds'}' AS reason" for n, o in VECTORS.items()))
def verify_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame([(n, json.dumps(d)) for n, d in vector_documents(spark).items()], "vector string, document string")
    return verify_documents(docs, TEST_PUBLIC).drop("document")
