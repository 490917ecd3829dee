"""Versioned tables behind one pointer: readers see whole versions, writers can be asked what they would change.

Below a root, `data` holds every table that was ever written and `versions` one small JSON file a version, which names
the tables of that version. The file of the greatest number is the current one. A file appears by a rename, whole or not
at all, and only one writer can take a number; tables are written before, so what fails leaves nothing that is named.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Taken(RuntimeError):
    """Another writer has published since the version that this one builds on."""


def changes(old, new, key):
    """(key..., change): rows of new that old lacks (added) or has with other values (changed), and rows that only old has (removed).

    Rows are compared as wholes, nulls as equal. Keys are unique in each table; null keys match each other.
    """
    key = [key] if isinstance(key, str) else list(key)
    if sorted(old.columns) != sorted(new.columns):
        raise ValueError(f"columns differ: {sorted(old.columns)} and {sorted(new.columns)}")
    rest = [c for c in old.columns if c not in key]
    side = lambda df, name: df.select(*(F.col(f"`{k}`").alias(f"{name}{i}") for i, k in enumerate(key)), F.struct(F.lit(1), *(F.col(f"`{c}`") for c in rest)).alias(name))
    match = reduce(lambda a, b: a & b, (F.col(f"a{i}").eqNullSafe(F.col(f"b{i}")) for i in range(len(key))))
    both = side(old, "a").join(side(new, "b"), match, "full").where(~F.col("a").eqNullSafe(F.col("b")))
    names = [F.when(F.col("a").isNull(), F.col(f"b{i}")).otherwise(F.col(f"a{i}")).alias(k) for i, k in enumerate(key)]
    return both.select(*names, F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))


class Versions:
    """The versions of some named tables below a root, on any file system that Spark writes to."""

    def __init__(self, spark, root):
        self.spark, self.root, self._schemas = spark, root.rstrip("/"), {}
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def numbers(self):
        """Numbers of all versions, in order."""
        if not self.fs.exists(self._path("versions")):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self._path("versions"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, version):
        version = (self.numbers() or [0])[-1] if version is None else version
        if not version:
            return {"tables": {}, "schemas": {}}
        stream = self.fs.open(self._path(f"versions/{version:010d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def tables(self, version=None):
        """{name: path or paths} of a version, the current one by default; empty before the first."""
        return self._manifest(version)["tables"]

    def read(self, name, version=None):
        """A table as it is in a version; what is published later doesn't reach this DataFrame. Several paths are one table."""
        manifest = self._manifest(version)
        paths = manifest["tables"][name]
        schema = lambda p: StructType.fromJson(json.loads(manifest["schemas"][p]))
        return reduce(DataFrame.unionByName, (self.spark.read.schema(schema(p)).parquet(p) for p in ([paths] if isinstance(paths, str) else paths)))

    def write(self, name, df, partition_by=()):
        """Write df as a table that no version names yet, and return its path."""
        path = f"{self.root}/data/{name}-{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(path)
        self._schemas[path] = df.schema.json()
        return path

    def publish(self, tables, base):
        """Name the tables {name: path or paths}, of write() or of base, as the version after base; Taken if there is one."""
        number = base + 1
        known = self._manifest(base)["schemas"] | self._schemas
        schemas = {p: known[p] for v in tables.values() for p in ([v] if isinstance(v, str) else v)}
        claim = self._path(f"versions/.{number:010d}.claim")
        try:
            self.fs.create(claim, False).close()
        except Exception as e:
            raise Taken(f"version {number} of {self.root}") from e
        if (self.numbers() or [0])[-1] != base:
            self.fs.delete(claim, False)
            raise Taken(f"version {number} of {self.root}")
        part = self._path(f"versions/.{uuid.uuid4().hex}")
        try:
            out = self.fs.create(part, False)
            out.write(bytearray(json.dumps({"tables": tables, "schemas": schemas}).encode()))
            out.close()
            if not self.fs.rename(part, self._path(f"versions/{number:010d}.json")):
                raise RuntimeError(f"version {number} of {self.root} couldn't be named")
        except BaseException:
            self.fs.delete(part, False)
            self.fs.delete(claim, False)  # else nobody could ever take the number
            raise
        return number

    def unlock(self):
        """Drop the claim of a writer that died before it could name its version; only when no writer runs."""
        self.fs.delete(self._path(f"versions/.{(self.numbers() or [0])[-1] + 1:010d}.claim"), False)

    def replace(self, name, df, key, dry_run=False, partition_by=()):
        """Make df the table of a new version; returns what changes by key, which dry_run finds without writing anything.

        The table is written first and compared with what is current, so what is returned is what the version changes.
        """
        base = (self.numbers() or [0])[-1]
        tables = self.tables(base)
        if dry_run:
            return changes(self.read(name, base) if name in tables else df.limit(0), df, key)
        path = self.write(name, df, partition_by)
        new = self.spark.read.schema(df.schema).parquet(path)
        old = self.read(name, base) if name in tables else new.limit(0)
        self.publish(tables | {name: path}, base)
        return changes(old, new, key)

    def restore(self, version):
        """Make the tables of an earlier version current again, as a new version."""
        self._schemas |= self._manifest(version)["schemas"]
        return self.publish(self.tables(version), (self.numbers() or [0])[-1])

    def forget(self, keep=1):
        """Delete all but the last versions, and the tables that only they name; returns the paths. Not while readers of them run."""
        numbers = self.numbers()
        flat = lambda n: {p for v in self.tables(n).values() for p in ([v] if isinstance(v, str) else v)}
        held = set().union(*(flat(n) for n in numbers[-keep:]))
        gone = sorted(set().union(*(flat(n) for n in numbers[:-keep])) - held)
        for n in numbers[:-keep]:
            self.fs.delete(self._path(f"versions/{n:010d}.json"), False)
        for p in gone:
            self.fs.delete(self.jvm.org.apache.hadoop.fs.Path(p), True)
        return gone
