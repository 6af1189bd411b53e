"""Pub/Sub by its REST interface, as a Python data source: one pull of at most max_messages, not acknowledged."""

from __future__ import annotations

import base64
import json
import os
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from ..functions.model import Boundary, ConnectorError, InvalidBoundary


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def read(self, partition) -> Iterator[tuple]:
        o = self.options
        url = f"{o['endpoint'].rstrip('/')}/v1/projects/{o['project']}/subscriptions/{o['subscription']}:pull"
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {o['token']}"} if o.get("token") else {})
        ask = urllib.request.Request(url, json.dumps({"maxMessages": int(o["max_messages"])}).encode(), head)
        try:
            with urllib.request.urlopen(ask, timeout=60) as answer:
                found = json.load(answer).get("receivedMessages", [])
        except (OSError, urllib.error.URLError) as e:
            raise ConnectorError(f"the pull failed: {e}") from e
        for i, m in enumerate(found):
            yield 0, i, base64.b64decode(m["message"].get("data", ""))


class PubSub(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pubsub_pull"

    def schema(self) -> str:
        return "partition int, offset long, value binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def pull(spark: SparkSession, project: str, subscription: str, boundary: Boundary, endpoint: str = "https://pubsub.googleapis.com", token: str | None = None) -> DataFrame:
    """(partition, offset, value) of one pull; offset is the message's place in the answer. The token is that of PUBSUB_TOKEN by default."""
    n = boundary.parsed().get("max_messages")
    if not isinstance(n, int) or n < 1:
        raise InvalidBoundary("no max_messages")
    spark.dataSource.register(PubSub)
    token = token or os.environ.get("PUBSUB_TOKEN", "")
    return spark.read.format("pubsub_pull").options(project=project, subscription=subscription, max_messages=str(n), endpoint=endpoint, token=token).load()
