"""Reconciliation of a sink that holds the source in another form.

What happens on the way is declared: which rows are taken, what each field of the sink
is as an expression over the source, and, where many source rows become one, which
fields group them and what is summed. The declaration is applied to the source as a
plan, and its result is fingerprinted and compared like any side. A record of the sink
that is missing or changed leads back to the source rows that make it up.

Scale: row-wise fields stay a map; sums are decimals, so their result doesn't depend on
the order of rows, and are summed before the exchange: a group with a third of all
rows is a few partial sums. Going back to source rows broadcasts a set of
bits, about 16 for each key asked for, so that few other rows go on; the keys themselves
are broadcast only where they are at most SMALL, else joined by exchange with what is left.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import fingerprints
from ..functions.model import Policy, ReconError
from ..sources.stores import stored
from .reconcile import Reconciliation, marked, reconcile, spot

#: Groups (under 200 bytes each) that are broadcast to find their source rows.
SMALL = 200_000
_AGGREGATES = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Transform:
    """fields: name in the sink to SQL expression over the source. where: SQL condition, of rows that are taken.

    With group_by, names among fields, rows of equal values become one: its other fields
    are in aggregates, name to (sum, count, min or max, expression); sums are of decimals
    with scale fraction digits, counts of rows where the expression isn't null, or of all
    where it is *. Null keys are equal to each other.
    """

    fields: dict[str, str]
    where: str | None = None
    group_by: tuple[str, ...] = ()
    aggregates: dict[str, tuple[str, str]] = field(default_factory=dict)
    scale: int = 6

    def __post_init__(self):
        if self.aggregates and not self.group_by:
            raise ReconError("aggregates need group_by")
        if self.group_by and set(self.group_by) != set(self.fields):
            raise ReconError("with group_by, every other field is an aggregate")
        if wrong := [f for f, _ in self.aggregates.values() if f not in _AGGREGATES]:
            raise ReconError(f"unknown aggregate: {wrong[0]}")
        if both := set(self.aggregates) & set(self.fields):
            raise ReconError(f"two definitions of a field: {sorted(both)[0]}")

    def _mapped(self, rows: DataFrame, *more: str) -> DataFrame:
        taken = rows.where(self.where) if self.where else rows
        return taken.select(*(F.expr(e).alias(n) for n, e in self.fields.items()), *more)

    def apply(self, rows: DataFrame) -> DataFrame:
        """The rows that the sink should hold. An empty source gives none. A sum beyond 38 digits is an error."""
        if not self.group_by:
            return self._mapped(rows)
        wide = T.DecimalType(28, self.scale)
        inner = {n: F.expr(e).cast(wide) if f == "sum" else F.lit(1) if (f, e) == ("count", "*") else F.expr(e) for n, (f, e) in self.aggregates.items()}
        taken = rows.where(self.where) if self.where else rows
        x = taken.select(*(F.expr(e).alias(n) for n, e in self.fields.items()), *(c.alias(f"__a{i}") for i, c in enumerate(inner.values())))
        return x.groupBy(*self.group_by).agg(*(_AGGREGATES[f](f"__a{i}").alias(n) for i, (n, (f, _)) in enumerate(self.aggregates.items())))

    def contributors(self, rows: DataFrame, records: DataFrame, policy: Policy, salt: bytes) -> DataFrame:
        """Source rows behind some of the sink's identities, with id_hash. records has id_hash; repeated ones count once.

        The identity's fields have to be in fields: for groups, among the keys.
        """
        if missing := [f for f in policy.identity if f not in self.fields]:
            raise ReconError(f"the identity isn't a field of single source rows: {missing[0]}")
        ids = stored(records.select("id_hash").distinct(), "ids")
        taken = rows.where(self.where) if self.where else rows
        columns = [c for c in rows.columns if c != "id_hash"]
        own = taken.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("pos"), *(F.expr(self.fields[f]).alias(f) for f in dict.fromkeys(policy.identity)))
        keyed = fingerprints(own, Policy(policy.identity_rule, (), canon=policy.canon, hash_algorithm=policy.hash_algorithm), salt)
        n = ids.count()
        return marked(keyed, ids.select(spot().alias("spot")), n).join(F.broadcast(ids) if n <= SMALL else ids, "id_hash").select("id_hash", "pos.*")


def reconcile_transformed(source: DataFrame, sink: DataFrame, transform: Transform, policy: Policy, salt: bytes) -> Reconciliation:
    """The declared form of the source against the sink. Policy and salt are the sink's; a field that the policy names and the transform doesn't make is an error.

    Rows have positions only if the transform makes a field pos and the sink has it.
    """
    want = transform.apply(source)
    if missing := [f for f in [*policy.identity, *policy.effective] if f not in want.columns]:
        raise ReconError(f"the transform doesn't make the field {missing[0]}")
    types = {f.name: f.dataType for f in sink.schema.fields}
    want = want.select(*(F.col(f"`{c}`").cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in want.columns))
    return reconcile(fingerprints(want, policy, salt), fingerprints(sink, policy, salt), policy.hash_algorithm)
