"""Snapshots in versions that are switched to when they are complete.

A table is a folder of versions. A version counts once its marker is there, so a
load that fails leaves the version before it as it was, and a reader never sees
half of one. A version is either a folder of its own, or its marker says which
files each of its parts has: then only the parts that a load changes are written,
and all others are those of the version before. Old versions stay until they are
dropped."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def versions(self, table: str) -> list[int]:
        """The versions of a table that are complete."""
        fs, p = self._fs(f"{self.root}/{table}")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[1:-3]) for n in names if n.startswith("v") and n.endswith(".ok"))

    def write(self, table: str, df: DataFrame, partition_by: list[str] | None = None, note: str = "") -> int:
        """Writes the next version and switches to it. `note` is kept in the
        marker, and so is the schema, as folders alone don't tell a column's type.
        A version's number is claimed by a file that only one writer can create, so
        of two writers each has a version of its own; what a failed write leaves
        is never read."""
        version = self._next(table)
        path = f"{self.root}/{table}/v{version}"
        writer = df.write.mode("overwrite")  # what is there is not complete
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        self._mark(table, version, {"note": note, "schema": df.schema.jsonValue()})
        return version

    def write_parts(self, table: str, df: DataFrame, by: str, replace: Iterable[str] | None = None, note: str | Callable[[DataFrame], str] = "", finish: Callable[[DataFrame], DataFrame] = lambda rows: rows, **more) -> int:
        """Writes rows in parts, one for each value of column `by` (a string, not
        null), and switches to a version in which the parts named in `replace` have
        these rows only (or none), other parts these beside their own, and all the
        rest are as before. Without `replace` nothing of the version before stays.
        `more` is kept in the marker. Rows of a part come together where they fit; a
        large part is split among tasks. `note` may be a function of the rows as they
        are written; if it raises an error, they are deleted and nothing is switched to.
        `finish` is applied after parts have come together, so columns that it makes are
        not shuffled."""
        before = self.marker(table) or {}
        parts = {} if replace is None else {p: f for p, f in before.get("parts", {}).items() if p not in set(replace)}
        version = self._next(table)
        folder = f"{self.root}/{table}/data/w={uuid.uuid4().hex}"
        df = finish(df.hint("rebalance", by))
        df.write.partitionBy(by).parquet(folder)
        fs, p = self._fs(folder)
        if callable(note):
            try:
                note = note(self.spark.read.schema(df.schema).parquet(folder).select(*df.columns))
            except Exception:
                fs.delete(p, True)
                raise
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if name.startswith(f"{by}="):
                value = re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), name[len(by) + 1 :])
                parts[value] = [*parts.get(value, []), f"{folder}/{name}"]
        self._mark(table, version, {"note": note, "schema": df.schema.jsonValue(), "by": by, "parts": parts} | more)
        return version

    def _next(self, table: str) -> int:
        found = self.versions(table)
        version = (found[-1] if found else 0) + 1
        while not self._claimed(f"{self.root}/{table}/v{version}.claim"):
            version += 1
        return version

    def _mark(self, table: str, version: int, content: dict) -> None:
        fs, marker = self._fs(f"{self.root}/{table}/v{version}.ok")
        out = fs.create(marker, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()

    def _claimed(self, path: str) -> bool:
        fs, p = self._fs(path)
        try:
            fs.create(p, False).close()
            return True
        except Exception:
            if fs.exists(p):
                return False
            raise

    def append(self, table: str, df: DataFrame) -> None:
        """Adds rows to a table that is only ever added to."""
        df.write.mode("append").parquet(f"{self.root}/{table}/rows")

    def replace(self, table: str, part: str, df: DataFrame) -> None:
        """Rows of a table that is added to, as a part that a second call replaces."""
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/rows/part={part}")

    def read_rows(self, table: str, schema) -> DataFrame:
        fs, p = self._fs(f"{self.root}/{table}/rows")
        return self.spark.read.schema(schema).parquet(str(p)).select(*schema.names) if fs.exists(p) else self.spark.createDataFrame([], schema)

    def read(self, table: str, version: int | None = None, parts: Iterable[str] | None = None) -> DataFrame | None:
        """A version, by default the current one, or None before the first; of one
        in parts only `parts`, if given. A filter on the column that makes the parts
        leaves out their files too."""
        found = self.versions(table)
        if not found:
            return None
        version = version or found[-1]
        marker = self._marker(table, version)
        schema = T.StructType.fromJson(marker["schema"])
        if "parts" not in marker:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{table}/v{version}").select(*schema.names)
        chosen = marker["parts"] if parts is None else {p: marker["parts"][p] for p in parts if p in marker["parts"]}
        files = [f for fs in chosen.values() for f in fs]
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}/data").parquet(*files).select(*schema.names)

    def marker(self, table: str) -> dict | None:
        """What the current version's marker holds."""
        found = self.versions(table)
        return self._marker(table, found[-1]) if found else None

    def _marker(self, table: str, version: int) -> dict:
        fs, p = self._fs(f"{self.root}/{table}/v{version}.ok")
        stream = fs.open(p)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def note(self, table: str) -> str:
        """The note of the current version."""
        found = self.versions(table)
        return self._marker(table, found[-1])["note"] if found else ""

    def notes(self, table: str) -> list[str]:
        """The notes of all versions that are there, the current one's first."""
        return [self._marker(table, v)["note"] for v in reversed(self.versions(table))]

    def drop_before(self, table: str, keep: int = 2) -> None:
        """Deletes all but the last `keep` versions, and the parts that no other
        version has."""
        files = lambda v: {f for fs in self._marker(table, v).get("parts", {}).values() for f in fs}
        found = self.versions(table)
        used = set().union(*[files(v) for v in found[-keep:]])
        for version in found[:-keep]:
            gone = files(version) - used
            for path in (f"{self.root}/{table}/v{version}.ok", f"{self.root}/{table}/v{version}", f"{self.root}/{table}/v{version}.claim", *gone):
                fs, p = self._fs(path)
                fs.delete(p, True)
