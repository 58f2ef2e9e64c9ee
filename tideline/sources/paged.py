"""Paged scans of remote ledgers as Python Data Sources: keyset and offset pagination, retries, snapshots.

A transport answers one request. `http://` and `https://` bases are posted to; a folder answers from files of JSON
lines, `<entity>.jsonl`, as the service would, for use without a network.
"""

from __future__ import annotations

import json
import os
import time
import urllib.request
from bisect import bisect_right
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FILL_SCHEMA = "fill_id string, transactionHash string, timestamp string, maker string, taker string, makerAssetId string, takerAssetId string, makerAmountFilled string, takerAmountFilled string, fee string"
_TABLES: dict[str, list[dict]] = {}


def with_retry(call: Callable[[], dict], retries: int = 5, wait: Callable[[float], None] = time.sleep) -> dict:
    """The answer of a call that may fail for a while: after failure n it waits 2^n seconds; the last failure is raised."""
    for n in range(retries):
        try:
            return call()
        except (OSError, ValueError):
            if n + 1 == retries:
                raise
            wait(2.0**n)
    raise ValueError("retries must be positive")


def _lines(base: str, entity: str) -> list[dict]:
    path = os.path.join(base.removeprefix("file://"), f"{entity}.jsonl")
    if path not in _TABLES:
        with open(path, encoding="utf-8") as file:
            _TABLES[path] = [json.loads(x) for x in file if x.strip()]
    return _TABLES[path]


def fetch(base: str, request: dict, retries: int = 5) -> dict:
    """One page: {'rows': [...]}. Keyset requests have field, values, after, key and first, offset requests offset and limit."""
    if base.startswith(("http://", "https://")):

        def call() -> dict:
            body = urllib.request.Request(base, json.dumps(request).encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(body, timeout=60) as answer:
                got = json.load(answer)
            if got.get("errors"):
                raise ValueError(str(got["errors"]))
            return got

        return with_retry(call, retries)
    rows = _lines(base, request["entity"])
    if "offset" in request:
        return {"rows": rows[request["offset"] : request["offset"] + request["limit"]]}
    wanted = set(request["values"])
    ordered = sorted((r for r in rows if r[request["field"]] in wanted), key=lambda r: r[request["key"]])
    start = bisect_right([r[request["key"]] for r in ordered], request["after"])
    return {"rows": ordered[start : start + request["first"]]}


def keyset_pages(base: str, entity: str, field: str, values: list[str], key: str = "fill_id", page: int = 1000, max_pages: int = 0) -> Iterator[dict]:
    """Rows whose `field` is among the values, page by page after the last key seen, until a short page or max_pages."""
    after, pages = "", 0
    while True:
        rows = fetch(base, {"entity": entity, "field": field, "values": values, "key": key, "after": after, "first": page})["rows"]
        yield from rows
        pages += 1
        if len(rows) < page or pages == max_pages:
            return
        after = rows[-1][key]


def offset_pages(base: str, entity: str, page: int = 1000, last_offset: int = 3000) -> Iterator[dict]:
    """Rows by offset, a page at a time, until an empty page or the last offset that the service allows."""
    for offset in range(0, last_offset + 1, page):
        rows = fetch(base, {"entity": entity, "offset": offset, "limit": page})["rows"]
        if not rows:
            return
        yield from rows


class Side(InputPartition):
    def __init__(self, field: str | None):
        self.field = field


class PagedReader(DataSourceReader):
    """One task a side of the scan: pages follow each other by their last key, so a side can't be split."""

    def __init__(self, schema, options: dict[str, str]):
        self.names, self.options = schema.fieldNames(), dict(options)

    def partitions(self) -> list[Side]:
        fields = self.options.get("fields")
        return [Side(f) for f in fields.split(",")] if fields else [Side(None)]

    def read(self, partition: Side) -> Iterator[tuple]:
        o = self.options
        page = int(o.get("page", "1000"))
        if partition.field is None:
            rows = offset_pages(o["base"], o["entity"], page, int(o.get("last_offset", "3000")))
        else:
            rows = keyset_pages(o["base"], o["entity"], partition.field, o["values"].split(","), o.get("key", "fill_id"), page, int(o.get("max_pages", "0")))
        for r in rows:
            yield tuple(r.get(n) for n in self.names)


class PagedLedger(DataSource):
    """spark.read.format('paged_ledger').option('base', ...).option('entity', ...).option('fields', 'a,b').option('values', ...)."""

    @classmethod
    def name(cls) -> str:
        return "paged_ledger"

    def schema(self) -> str:
        return FILL_SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(schema, self.options)


def scan_fills(spark: SparkSession, base: str, tokens: list[str], page: int = 1000, max_pages: int = 0) -> DataFrame:
    """Fills in which either leg is one of the tokens: both sides scanned, a fill that both return kept once.

    With max_pages (a smoke test's limit) every side stops after that many pages.
    """
    spark.dataSource.register(PagedLedger)
    read = spark.read.format("paged_ledger").option("base", base).option("entity", "fills").option("fields", "makerAssetId,takerAssetId")
    return read.option("values", ",".join(tokens)).option("page", page).option("max_pages", max_pages).load().dropDuplicates(["fill_id"])


def scan_activity(spark: SparkSession, base: str, schema: str, keys: list[str], page: int = 1000, last_offset: int = 3000) -> DataFrame:
    """An offset-paged listing, rows with equal `keys` once, in their order. Pages shift while they are read, so rows repeat."""
    spark.dataSource.register(PagedLedger)
    read = spark.read.format("paged_ledger").schema(schema).option("base", base).option("entity", "activity").option("page", page).option("last_offset", last_offset)
    return read.load().dropDuplicates(keys).orderBy(*keys)


def snapshot(base: str, slug: str, path: str) -> dict:
    """The single event under a slug, frozen as the raw JSON that came; more or fewer than one is an error."""
    got = fetch(base, {"entity": "events", "field": "slug", "values": [slug], "key": "slug", "after": "", "first": 10})["rows"]
    if len(got) != 1:
        raise ValueError(f"{slug}: {len(got)} events, not 1")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(got[0], file, sort_keys=True)
    return got[0]


def block_height(base: str) -> int:
    """The block up to which the service has indexed."""
    rows = fetch(base, {"entity": "meta", "offset": 0, "limit": 1})["rows"]
    return int(rows[0]["block"])
