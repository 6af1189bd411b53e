"""Policies, canonical form, boundaries and the errors."""

from __future__ import annotations

import dataclasses
import json
import re
from dataclasses import dataclass, field
from enum import Enum


class ReconError(ValueError):
    """Base of what a plan or a document can get wrong."""


class MissingIdentityField(ReconError): ...


class InvalidIdentityRule(ReconError): ...


class UnsupportedCanonVersion(ReconError): ...


class UnknownHashAlgorithm(ReconError): ...


class LeafNotFound(ReconError): ...


class ConnectorError(ReconError): ...


class InvalidBoundary(ConnectorError): ...


class SchemaDriftError(ConnectorError): ...


class Verdict(str, Enum):
    PASS = "PASS"
    FAIL = "FAIL"
    UNVERIFIED = "UNVERIFIED"


class BoundaryMode(str, Enum):
    OFFSET_RANGE = "OFFSET_RANGE"
    TIME_WINDOW = "TIME_WINDOW"
    BATCH_ID = "BATCH_ID"


class PositionKind(str, Enum):
    KAFKA_OFFSET = "KAFKA_OFFSET"
    PUBSUB_MSGID = "PUBSUB_MSGID"
    ICEBERG_ROW = "ICEBERG_ROW"
    CDC_LSN = "CDC_LSN"
    FILE_ROW = "FILE_ROW"


class DuplicatePolicy(str, Enum):
    FORBID = "FORBID"
    ALLOW_IF_SINK_IDEMPOTENT = "ALLOW_IF_SINK_IDEMPOTENT"


@dataclass(frozen=True)
class CanonSpec:
    """The last three are extensions of this engine: integers as "string" or "decimal", nested structs, and no look at normal forms."""

    version: int = 1
    timestamp_precision: str = "micros"
    decimal_scale: int = 6
    unicode: str = "NFC"
    null_token: str = "\0"
    field_order: str = "lexicographic"
    array_as_set: bool = False
    integers: str = "string"
    nested: bool = False
    ascii_only: bool = False

    def replaced(self, **kw) -> CanonSpec:
        return dataclasses.replace(self, **kw)


@dataclass(frozen=True)
class Tolerances:
    max_drops: int = 0
    duplicates: DuplicatePolicy = DuplicatePolicy.FORBID
    max_mutations: int = 0

    @classmethod
    def parse(cls, d: dict) -> Tolerances:
        try:
            return cls(int(d.get("max_drops", 0)), DuplicatePolicy(d.get("duplicates", "FORBID")), int(d.get("max_mutations", 0)))
        except ValueError as e:
            raise ReconError(f"unknown tolerance: {e}") from e


@dataclass(frozen=True)
class Policy:
    identity_rule: str
    content_fields: tuple[str, ...]
    exclude_fields: tuple[str, ...] = ()
    canon: CanonSpec = field(default_factory=CanonSpec)
    hash_algorithm: str = "sha256"
    tolerances: Tolerances = field(default_factory=Tolerances)
    late_arrival_window: str = "900s"

    @property
    def identity(self) -> list[str]:
        return identity_fields(self.identity_rule)

    @property
    def effective(self) -> list[str]:
        return [f for f in self.content_fields if f not in set(self.exclude_fields)]


@dataclass(frozen=True)
class Boundary:
    mode: BoundaryMode
    value: bytes

    @classmethod
    def of(cls, mode: BoundaryMode | str, value: dict) -> Boundary:
        return cls(BoundaryMode(mode), json.dumps(value, separators=(",", ":")).encode())

    def parsed(self, mode: BoundaryMode | None = None) -> dict:
        if not self.value:
            raise InvalidBoundary("the boundary is empty")
        if mode is not None and self.mode is not mode:
            raise InvalidBoundary(f"{mode.value} is needed, not {self.mode.value}")
        try:
            out = json.loads(self.value)
        except ValueError as e:
            raise InvalidBoundary(f"the boundary is no JSON: {e}") from e
        if not isinstance(out, dict):
            raise InvalidBoundary("the boundary is no JSON object")
        return out


def identity_fields(rule: str) -> list[str]:
    """field:<name> or composite:[a,b,...]; the order counts."""
    if rule.startswith("field:"):
        names = [rule[6:].strip()]
    elif m := re.fullmatch(r"composite:\[(.*)\]", rule.strip(), re.S):
        names = [x.strip() for x in m[1].split(",")]
    else:
        raise InvalidIdentityRule(f"invalid identity rule: {rule}")
    if not all(names):
        raise InvalidIdentityRule(f"an empty name in the identity rule: {rule}")
    return names


def late_window_seconds(text: str) -> int | None:
    """900s, 120 or PT15M in seconds; None for anything else."""
    if m := re.fullmatch(r"(\d+)s?", text.strip()):
        return int(m[1])
    if m := re.fullmatch(r"PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?", text.strip()):
        if any(m.groups()):
            h, mi, s = (int(x or 0) for x in m.groups())
            return 3600 * h + 60 * mi + s
    return None


@dataclass(frozen=True)
class SchemaDrift:
    missing: list[str]
    unexpected: list[str]


def check_schema_drift(expected: list[str], actual: list[str]) -> SchemaDrift | None:
    missing, more = sorted(set(expected) - set(actual)), sorted(set(actual) - set(expected))
    return SchemaDrift(missing, more) if missing or more else None


def require_no_drift(expected: list[str], actual: list[str]) -> None:
    if d := check_schema_drift(expected, actual):
        raise SchemaDriftError(f"missing {d.missing}, unexpected {d.unexpected}")
