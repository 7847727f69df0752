"""Tables that are changed in place: Parquet folders, and manifests that tell which of them make up a version.

A change writes new folders beside the old ones and then one manifest, by a rename that fails where that version is there already. So a version is seen
whole or not at all, whatever tables it changes together; a writer that is killed leaves folders that no manifest names; and of two writers at a time one fails. Each change
has a token: a retry of a change that has been made changes nothing. Rows of a keyed table lie in PARTS folders by a hash of their key, so that
replacing some keys rewrites only the folders that hold any.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folders that the rows of a keyed table are dealt to; folders of one part beyond which an append rewrites it; and changes that a retry may come after.
PARTS, APPENDS, TOKENS = 16, 8, 1000


@dataclass(frozen=True)
class Change:
    """How a table is changed: kind is whole, replaced, absent or added; keys are the columns by which rows are replaced or known."""

    kind: str
    rows: DataFrame
    keys: tuple[str, ...] = ()
    scope: DataFrame | None = None


def whole(rows: DataFrame, *keys: str) -> Change:
    """All rows go, these come."""
    return Change("whole", rows, keys)


def replaced(rows: DataFrame, *keys: str, scope: DataFrame | None = None) -> Change:
    """Rows go whose keys occur in scope, or where none is given in rows; rows come. Null keys are equal to each other."""
    return Change("replaced", rows, keys, scope)


def absent(rows: DataFrame, *keys: str) -> Change:
    """Of rows those come whose keys aren't there; of rows of one key one comes, whichever is first in the order of all its values."""
    return Change("absent", rows, keys)


def added(rows: DataFrame, *keys: str) -> Change:
    """Rows come."""
    return Change("added", rows, keys)


class Store:
    """The tables of a folder. Opening one that isn't there makes an empty one at its first change."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self._jvm = spark, path.rstrip("/"), spark._jvm
        self._hadoop = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- manifests ------------------------------------------------------------------------------

    def version(self) -> int:
        """The last version; 0 is the empty one."""
        at = self._hadoop(f"{self.path}/versions")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return max((int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit()), default=0)

    def _manifest(self, version: int) -> dict:
        if not version:
            return {"tables": {}, "tokens": []}
        stream = self._fs.open(self._hadoop(f"{self.path}/versions/{version:012d}.json"))
        try:
            reader = self._jvm.java.io.BufferedReader(self._jvm.java.io.InputStreamReader(stream, "UTF-8"))
            return json.loads(reader.readLine())
        finally:
            stream.close()

    def _publish(self, version: int, manifest: dict) -> None:
        draft = self._hadoop(f"{self.path}/drafts/{uuid.uuid4().hex}.json")
        out = self._fs.create(draft, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        final = self._hadoop(f"{self.path}/versions/{version:012d}.json")
        self._fs.mkdirs(final.getParent())
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, final, self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            raise Conflict(f"version {version} of {self.path} is there already") from e

    # --- reading and changing -------------------------------------------------------------------

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The rows of a table as they are in a version, by default the last."""
        held = self._manifest(self.version() if version is None else version)["tables"].get(name)
        if held is None:
            raise KeyError(name)
        return self._rows(held, held["parts"])

    def _rows(self, held: dict, parts: dict[str, list[str]]) -> DataFrame:
        schema, folders = StructType.fromJson(held["schema"]), [f"{self.path}/{f}" for part in parts.values() for f in part]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def commit(self, changes: dict[str, Change], token: str) -> int:
        """Make all changes together, as one version, and tell its number; a token that has been used is a change that has been made."""
        before = self.version()
        manifest = self._manifest(before)
        if token in manifest["tokens"]:
            return before
        tables = dict(manifest["tables"])
        for name, change in changes.items():
            tables[name] = self._changed(name, tables.get(name), change)
        self._publish(before + 1, {"tables": tables, "tokens": [*manifest["tokens"], token][-TOKENS:]})
        return before + 1

    def _changed(self, name: str, held: dict | None, change: Change) -> dict:
        keys = list(change.keys)
        schema = change.rows.schema
        if held is None or change.kind == "whole":
            rows = change.rows
            if change.kind == "absent":
                rows = _one(rows, keys)
            return {"schema": schema.jsonValue(), "keys": keys, "parts": self._write(name, rows, keys)}
        if held["keys"] != keys or [f.name for f in StructType.fromJson(held["schema"])] != schema.names:
            raise ValueError(f"{name} has the keys {held['keys']} and the columns {StructType.fromJson(held['schema']).names}")
        parts = dict(held["parts"])
        if change.kind == "added":
            new = self._write(name, change.rows, keys)
            full = [p for p in new if len(parts.get(p, [])) >= APPENDS]
            merged = self._write(name, self._rows(held, {p: parts[p] + new[p] for p in full}), keys) if full else {}
            return held | {"parts": parts | {p: merged[p] if p in full else parts.get(p, []) + f for p, f in new.items()}}
        known = [f"_{k}" for k in keys]
        scope = (change.scope if change.scope is not None else change.rows).select(*(F.col(k).alias(n) for k, n in zip(keys, known, strict=True))).distinct()
        touched = [str(r[0]) for r in scope.select(_part([F.col(n) for n in known])).distinct().collect()]
        old = self._rows(held, {p: parts[p] for p in touched if p in parts})
        same = lambda a, b: reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[n]) for k, n in zip(keys, known, strict=True)))
        if change.kind == "replaced":
            if change.scope is not None and not change.rows.join(scope, same(change.rows, scope), "left_anti").isEmpty():
                raise ValueError("rows of a replacement must have keys of its scope")
            new = old.join(scope, same(old, scope), "left_anti").unionByName(change.rows)
        else:
            there = old.select(*(F.col(k).alias(n) for k, n in zip(keys, known, strict=True))).distinct()
            fresh = _one(change.rows, keys)
            new = old.unionByName(fresh.join(there, same(fresh, there), "left_anti"))
        written = self._write(name, new, keys)
        return held | {"parts": {p: f for p, f in parts.items() if p not in touched} | written}

    def _write(self, name: str, rows: DataFrame, keys: list[str]) -> dict[str, list[str]]:
        """Write rows to a new folder for each part that has any."""
        folder = f"data/{name}-{uuid.uuid4().hex}"
        part = _part([F.col(k) for k in keys])
        dealt = rows.withColumn("_part", part).repartition("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(4))) if keys else rows.withColumn("_part", F.lit(0))
        dealt.write.partitionBy("_part").parquet(f"{self.path}/{folder}")
        found = [f.getPath().getName() for f in self._fs.listStatus(self._hadoop(f"{self.path}/{folder}"))]
        return {n.removeprefix("_part="): [f"{folder}/{n}"] for n in sorted(found) if n.startswith("_part=")}


class Conflict(RuntimeError):
    """Another writer has made a version meanwhile: read again and retry."""


def _part(keys: list[Column]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int") if keys else F.lit(0)


def _one(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key: the smallest by its other columns, picked by a partial aggregate."""
    more = [c for c in rows.columns if c not in keys]
    if not more:
        return rows.distinct()
    return rows.groupBy(*keys).agg(F.min(F.struct(*more)).alias("_x")).select(*(F.col(c) if c in keys else F.col(f"_x.{c}") for c in rows.columns))


def appends(store: Store, name: str, stream: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: an epoch of a stream is appended to a table once, however often it is retried."""

    def sink(rows: DataFrame, epoch: int) -> None:
        while True:
            try:
                store.commit({name: added(rows)}, f"{stream}-{epoch}")
                return
            except Conflict:
                continue

    return sink
