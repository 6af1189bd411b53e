"""A reconciliation's configuration as YAML."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from ..functions.model import Boundary, Policy, ReconError, Tolerances
from ..sources.stores import StoreConfig

#: The configuration that init writes; paths are under its data folder.
TEMPLATE = """\
producer: tallyglass
source: {{type: memory_kafka, topic: orders, boundary: {{partitions: [{{id: 0, start: 0, end: 4}}]}}}}
sink: {{type: iceberg, warehouse: {data}/warehouse, table: orders, boundary: {{snapshot_from: 1, snapshot_to: 1}}}}
policy:
  identity_rule: "composite:[order_id,line_id]"
  hash_algorithm: sha256
  content_fields: [order_id, line_id, amount, status]
  exclude_fields: []
  tolerances: {{max_drops: 0, max_mutations: 0, duplicates: FORBID}}
  late_arrival_window: 900s
crypto: {{private_key_file: {data}/keys/signing.key.b64, public_key_file: {data}/keys/signing.pub.b64, kms_provider: file}}
store: {{kind: local, proofs_dir: {data}/proofs}}
"""


@dataclass(frozen=True)
class ReconConfig:
    producer: str
    source: dict
    sink: dict
    policy: dict
    crypto: dict
    store: dict = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> ReconConfig:
        try:
            d = yaml.safe_load(text)
            c = cls(**d)
        except (yaml.YAMLError, TypeError) as e:
            raise ReconError(f"the configuration can't be read: {e}") from e
        for part, needed in (("source", ("type", "topic", "boundary")), ("sink", ("type", "table", "boundary")), ("policy", ("identity_rule", "hash_algorithm", "content_fields", "tolerances")), ("crypto", ("private_key_file", "public_key_file"))):
            section = getattr(c, part)
            if not isinstance(section, dict) or (lacks := [k for k in needed if k not in section]):
                raise ReconError(f"the configuration's {part} lacks {', '.join(lacks) if isinstance(section, dict) else 'everything'}")
        return c

    @classmethod
    def load(cls, path: str) -> ReconConfig:
        return cls.parse(Path(path).read_text())

    def save(self, path: str) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(yaml.safe_dump(dataclasses.asdict(self), sort_keys=False))

    def to_policy(self) -> Policy:
        p = self.policy
        return Policy(p["identity_rule"], tuple(p["content_fields"]), tuple(p.get("exclude_fields") or ()), hash_algorithm=p["hash_algorithm"], tolerances=Tolerances.parse(p["tolerances"]), late_arrival_window=p.get("late_arrival_window") or "900s")

    def source_boundary(self) -> Boundary:
        b = self.source["boundary"]
        return Boundary.of("OFFSET_RANGE" if "partitions" in b else "BATCH_ID", b)

    def sink_boundary(self) -> Boundary:
        return Boundary.of("BATCH_ID", self.sink["boundary"])

    def store_config(self) -> StoreConfig:
        return StoreConfig(**self.store)
