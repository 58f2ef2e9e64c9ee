"""Files beside tables: metadata with arrays inside strings, scenario folders, vectors, deterministic sinks, digests, builds."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.expr import utc_seconds

VOLATILE = ("elapsed_seconds", "created_at", "hostname")


def markets_of(spark: SparkSession, path: str) -> DataFrame:
    """One row a market of raw event JSON, whose outcome names, token ids and prices are arrays written as strings.

    The resolved outcome is the one whose price is 1; null while none is. A market without both a Yes and a No token
    stays, with null tokens.
    """
    schema = "slug string, markets array<struct<conditionId: string, question: string, outcomes: string, clobTokenIds: string, outcomePrices: string, closedTime: string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select("slug", F.explode("markets").alias("m"))
    names, tokens, prices = (F.from_json(F.col(f"m.{c}"), "array<string>") for c in ("outcomes", "clobTokenIds", "outcomePrices"))
    told = rows.select("slug", F.col("m.conditionId").alias("condition_id"), F.trim("m.question").alias("question"), names.alias("names"), tokens.alias("tokens"), prices.alias("prices"), utc_seconds(F.col("m.closedTime")).alias("closed_time"))
    token = lambda name: F.when(F.array_contains("names", name), F.try_element_at("tokens", F.array_position("names", F.lit(name)).cast("int")))
    won = F.array_position(F.transform("prices", lambda p: p.cast("double") == 1.0), True)
    resolved = F.when(won > 0, F.try_element_at("names", won.cast("int")))
    return told.select("slug", "condition_id", "question", token("Yes").alias("yes_token_id"), token("No").alias("no_token_id"), resolved.alias("resolved_outcome"), "closed_time")


def token_universe(metadata: DataFrame) -> DataFrame:
    """All token ids, and of how many markets each is: one in a sound table."""
    both = metadata.select(F.explode(F.array("yes_token_id", "no_token_id")).alias("token_id"), "condition_id")
    return both.where("token_id IS NOT NULL").groupBy("token_id").agg(F.count(F.lit(1)).alias("markets"))


def scenarios(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Trades and manifests of every folder under root that holds both, with the folder's name as scenario_id."""
    name = lambda: F.regexp_extract(F.input_file_name(), "([^/]+)/[^/]+$", 1)
    trades = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "trades*.parquet").parquet(root).withColumn("scenario_id", name())
    manifests = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").option("multiLine", True).json(root).withColumn("scenario_id", name())
    there = manifests.select("scenario_id").distinct()
    return trades.join(there, "scenario_id", "left_semi"), manifests


def save_vector(df: DataFrame, path: str) -> str:
    """A column of whole numbers as a .npy file, in order, and its SHA-256: for vectors of a size that one file may have."""
    column = df.toArrow().column(0).to_numpy()
    np.save(path, column)
    return file_sha256(path)


def load_vector(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """(place, value) of a .npy file."""
    values = np.load(path, allow_pickle=False)
    return spark.createDataFrame([(i, int(v)) for i, v in enumerate(values.tolist())], f"place long, `{name}` long")


def dumps(value) -> str:
    """The same text for equal values: keys in order, no blanks, no NaN."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, allow_nan=False, separators=(",", ":"))


def digest_of(value) -> str:
    return hashlib.sha256(dumps(value).encode()).hexdigest()


def save_report(value: dict, path: str) -> str:
    """A report as JSON, without what changes from run to run; returns its digest."""

    def stable(x):
        if isinstance(x, dict):
            return {k: stable(v) for k, v in x.items() if k not in VOLATILE}
        return [stable(v) for v in x] if isinstance(x, list | tuple) else x

    text = dumps(stable(value))
    with open(path, "w", encoding="utf-8") as file:
        file.write(text + "\n")
    return hashlib.sha256(text.encode()).hexdigest()


def save_csv(df: DataFrame, path: str) -> None:
    """A summary as CSV with a header."""
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def file_sha256(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def folder_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(name, bytes, sha256) of the files under a path, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_inputs(spark: SparkSession, path: str, recorded: dict[str, str]) -> None:
    """Raise unless every recorded file is there with its digest."""
    now = {r.name: r.sha256 for r in folder_digests(spark, path).where(F.col("name").isin(list(recorded))).collect()}
    wrong = sorted(n for n, digest in recorded.items() if now.get(n) != digest)
    if wrong:
        raise ValueError(f"inputs missing or changed: {wrong}")


def save_manifest(spark: SparkSession, path: str, tables: dict[str, DataFrame], target: str) -> dict:
    """Rows of each table and digests of the files under path, as a manifest beside them."""
    told = {"tables": {n: df.count() for n, df in sorted(tables.items())}, "files": {r.name: r.sha256 for r in folder_digests(spark, path, "*.parquet").collect()}}
    save_report(told, target)
    return told


def build_id(parts: dict) -> str:
    """Sixteen hexadecimal digits that stand for a configuration and its inputs."""
    return digest_of(parts)[:16]


def stamped(df: DataFrame, build: str) -> DataFrame:
    return df.withColumn("build_id", F.lit(build))


def one_build(tables: dict[str, DataFrame]) -> str:
    """The build that all tables carry; tables of unlike builds are refused."""
    seen = None
    for name, df in sorted(tables.items()):
        rows = df.select(F.lit(name).alias("name"), "build_id").distinct()
        seen = rows if seen is None else seen.unionByName(rows)
    found = sorted({r.build_id or "" for r in seen.select("build_id").distinct().limit(2).collect()}) if seen is not None else []
    if len(found) != 1 or not found[0]:
        raise ValueError(f"tables of more than one build: {found}")
    return found[0]


class Tracks:
    """Named tracks, each a factory of the same tables; the one place where tracks differ."""

    def __init__(self) -> None:
        self._made: dict[str, Callable[[SparkSession], dict[str, DataFrame]]] = {}

    def register(self, name: str, make: Callable[[SparkSession], dict[str, DataFrame]]) -> None:
        if name in self._made:
            raise ValueError(f"track {name} is there already")
        self._made[name] = make

    def load(self, spark: SparkSession, name: str) -> dict[str, DataFrame]:
        if name not in self._made:
            raise ValueError(f"unknown track {name}; known: {sorted(self._made)}")
        return self._made[name](spark)


def frozen_plan(config: dict, code_files: list[str]) -> dict:
    """What a run is bound to: the configuration's digest and those of the files that compute it."""
    return {"config_sha256": digest_of(config), "code": {os.path.basename(p): file_sha256(p) for p in sorted(code_files)}}


def require_frozen(plan: dict, config: dict, code_files: list[str]) -> None:
    """Raise if the configuration or code is no longer what the plan was frozen with."""
    now = frozen_plan(config, code_files)
    changed = [k for k in ("config_sha256",) if now[k] != plan[k]] + sorted(n for n in {*now["code"], *plan["code"]} if now["code"].get(n) != plan["code"].get(n))
    if changed:
        raise ValueError(f"changed since the plan was frozen: {changed}")
