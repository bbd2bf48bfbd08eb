"""Tables in buckets, changed by several writers at once.

Rows are dealt to buckets by a hash of their key, and a version is a manifest: for each
bucket the folder that holds it.  A change writes only the buckets that it touches and
commits a manifest in which the others stay as they were; readers take one manifest and
see one state.  A manifest's number is claimed by a rename that fails if the number is
taken: then another writer was first, and the change is made again on top of its version.
A manifest also keeps the last batch of each source, so that a replayed batch is known.

On a file system whose rename is not exclusive (an object store without it) there has to be
one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Combine = Callable[[DataFrame | None, DataFrame], DataFrame]


@dataclass
class Manifest:
    """version -1 stands for a table without any."""

    version: int = -1
    folders: dict[int, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    schema: str | None = None

    def written(self) -> str:
        return json.dumps({"folders": self.folders, "batches": self.batches, "schema": self.schema})

    @staticmethod
    def read(version: int, text: str) -> Manifest:
        found = json.loads(text)
        return Manifest(version, {int(k): v for k, v in found["folders"].items()}, found["batches"], found["schema"])


class BucketTable:
    """A table at ``path`` whose rows are dealt to ``buckets`` by ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self._jvm = spark.sparkContext._jvm
        self._files = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    # -------------------------------------------------------------- manifests

    def versions(self) -> list[int]:
        if not self._files.exists(self._at("commits")):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._at("commits"))]
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> Manifest:
        held = self.versions()
        if not held and version is None:
            return Manifest()
        version = held[-1] if version is None else version
        stream = self._files.open(self._at(f"commits/{version:012}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest.read(version, text)

    def _commit(self, found: Manifest) -> bool:
        """Claims the manifest's number; False if it is taken."""
        loose = self._at(f"commits/.{uuid.uuid4().hex}")
        stream = self._files.create(loose, False)
        try:
            stream.write(bytearray(found.written().encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()) if self._at("").toUri().getScheme() else self._jvm.org.apache.hadoop.fs.FileContext.getFileContext()
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(loose, self._at(f"commits/{found.version:012}.json"), none)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in str(error.java_exception.getClass().getName()):
                raise
            self._files.delete(loose, False)
            return False
        return True

    # -------------------------------------------------------------- reading and changing

    def _folders(self, found: Manifest, buckets: list[int] | None = None) -> DataFrame | None:
        folders = sorted({f for b, f in found.folders.items() if buckets is None or b in buckets})
        return self.spark.read.schema(StructType.fromJson(json.loads(found.schema))).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of the newest or the given version, None before the first."""
        return self._folders(self.manifest(version))

    def change(self, rows: DataFrame, combine: Combine, source: str | None = None, batch: int | None = None, attempts: int = 20) -> int:
        """Replaces the buckets of ``rows`` by ``combine(their old rows or None, rows)``; the version that holds it.

        ``combine`` has to act key by key.  A ``batch`` of a ``source`` that is no later than the
        last one changes nothing.  ``rows`` are read again in each attempt.
        """
        for _ in range(attempts):
            before = self.manifest()
            if source is not None and batch is not None and before.batches.get(source, -1) >= batch:
                return before.version
            touched = [r[0] for r in rows.select(self._bucket()).distinct().collect()]  # at most ``buckets``
            after = Manifest(before.version + 1, dict(before.folders), dict(before.batches), before.schema)
            if source is not None and batch is not None:
                after.batches[source] = batch
            folder = f"data/{uuid.uuid4().hex}"
            if touched:
                made = combine(self._folders(before, touched), rows)
                after.schema = made.schema.json() if before.schema is None else before.schema
                made.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
                written = {s.getPath().getName() for s in self._files.listStatus(self._at(folder))}
                for b in touched:
                    after.folders.pop(b, None)
                    if f"_bucket={b}" in written:
                        after.folders[b] = f"{folder}/_bucket={b}"
            if self._commit(after):
                return after.version
            self._files.delete(self._at(folder), True)
        raise RuntimeError(f"{attempts} other writers were first each time")

    def prune(self, keep: int = 3) -> None:
        """Deletes all but the newest versions, and the folders that none of those names.

        Folders that no manifest names yet may be another writer's: only those go that an old version named.
        """
        held = self.versions()
        old, new = ([self.manifest(v) for v in part] for part in (held[:-keep], held[-keep:]))
        needed = {f for m in new for f in m.folders.values()}
        for m in old:
            for folder in set(m.folders.values()) - needed:
                self._files.delete(self._at(folder), True)
            self._files.delete(self._at(f"commits/{m.version:012}.json"), False)


def refresh_bars(wanted: DataFrame, table: BucketTable, fetch: Callable[[DataFrame], DataFrame], as_of: str, days: int = 5) -> DataFrame:
    """The bars of the wanted symbols, after those that are not fresh have been fetched.

    As ``tables.refresh_bars``, but only the buckets of fetched symbols are written anew; the
    table's key is the symbol.
    """
    symbols, held = wanted.select("symbol").distinct(), table.read()
    stale = symbols
    if held is not None:
        fresh = held.groupBy("symbol").agg(F.max("date").alias("last")).where(F.col("last") >= F.date_sub(F.lit(as_of).cast("date"), days))
        stale = symbols.join(fresh, "symbol", "left_anti")

    def replaced(old: DataFrame | None, new: DataFrame) -> DataFrame:
        return new if old is None else old.join(new.select("symbol").distinct(), "symbol", "left_anti").unionByName(new)

    if not stale.isEmpty():
        table.change(fetch(stale), replaced)
    found = table.read()
    return fetch(stale).limit(0) if found is None else found.join(symbols, "symbol", "left_semi")


def merge_into(table: BucketTable, source: str, retention_hours: int = 72, versions: int = 3) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for a timeline table whose key is the market; several streams may write at once.

    ``source`` names the stream: its batches that come again add no version.
    """
    from quantloom.operators.timeline import hour_dedup

    def combine(old: DataFrame | None, new: DataFrame) -> DataFrame:
        rows = hour_dedup(new if old is None else old.unionByName(new))
        newest = rows.groupBy("market").agg(F.max("timestamp").alias("_newest"))
        kept = rows.join(newest, "market").where(F.col("timestamp") >= F.col("_newest") - F.expr(f"INTERVAL {retention_hours} HOURS"))
        return kept.drop("_newest").select(new.columns)

    def merge(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # one batch, read for its buckets and in each attempt
        try:
            table.change(batch, combine, source, batch_id)
        finally:
            batch.unpersist()
        table.prune(versions)

    return merge
