"""Several tables written as one: versions in folders of their own and a small pointer file that is switched last.

A commit writes every table to a new folder and then publishes a manifest, the list of folders that make up each table, by
renaming it to the next number. The rename does not replace a file, so of two commits that began from one version the
second fails and changes nothing; a run that is killed before it leaves the old version readable, and only folders that
nothing points to. A table may be kept in slots (days, buckets of keys): then a commit writes the slots it holds, the
manifest keeps the folders of the others, and a reader that asks for some slots lists no other files. The last `keep`
versions stay, so that readers that have begun can end.

The rename must be atomic and must not replace files, as that of HDFS and of viewfs over it; a local folder serves tests."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SLOT = "_slot"


class Conflict(RuntimeError):
    """Another commit was published since this one began."""


class Snapshots:
    def __init__(self, spark: SparkSession, root: str, keep: int = 3):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), max(1, keep)
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        """The numbers of the versions that can be read, rising."""
        return [int(n[:-5]) for n in self._names("_versions") if n.endswith(".json") and n[:-5].isdigit()]

    def version(self) -> int:
        """The current version, 0 before the first commit."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """Tables by name: their schema and, by slot ("" for a whole table), the folder."""
        version = self.version() if version is None else version
        if not version:
            return {}
        stream = self._fs.open(self._path(f"_versions/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, slots: Iterable[str] | None = None, version: int | None = None) -> DataFrame:
        """A table as of a version; with slots, only their files."""
        table = self.manifest(version)[name]
        schema = T.StructType.fromJson(table["schema"])
        wanted = table["slots"] if slots is None else [s for s in map(str, slots) if s in table["slots"]]
        folders = [f"{self.root}/{table['slots'][s]}" for s in wanted]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def slots(self, name: str, version: int | None = None) -> list[str]:
        return sorted(self.manifest(version).get(name, {"slots": {}})["slots"])

    def commit(self, whole: dict[str, DataFrame] | None = None, slotted: dict[str, tuple[DataFrame, str]] | None = None, emptied: dict[str, Iterable[str]] | None = None, since: int | None = None) -> int:
        """Publishes new states of tables as one version and gives its number.

        whole: tables that are replaced; slotted: rows of whole slots and the column that is their slot, which replace these
        slots; emptied: slots that go before that. since: the version that the rows were made from (the current one)."""
        base = self.version() if since is None else since
        tables = self.manifest(base)
        for name, df in (whole or {}).items():
            folder = f"{name}/{uuid.uuid4().hex}"
            df.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
            tables[name] = {"schema": json.loads(df.schema.json()), "slots": {"": folder}}
        for name in {*(slotted or {}), *(emptied or {})}:
            old = tables.get(name, {"schema": None, "slots": {}})
            kept = {s: f for s, f in old["slots"].items() if s not in set(map(str, (emptied or {}).get(name, ())))}
            schema = old["schema"]
            if name in (slotted or {}):
                df, column = slotted[name]
                folder, schema = f"{name}/{uuid.uuid4().hex}", json.loads(df.schema.json())
                # rows of a slot come together, and Spark splits a slot that is much larger than others
                dealt = df.withColumn(_SLOT, F.coalesce(F.col(column).cast("string"), F.lit("null"))).hint("rebalance", _SLOT)
                dealt.write.option("compression", "zstd").partitionBy(_SLOT).parquet(f"{self.root}/{folder}")
                kept |= {unquote(n[len(_SLOT) + 1 :]): f"{folder}/{n}" for n in self._names(folder) if n.startswith(f"{_SLOT}=")}
            tables[name] = {"schema": schema, "slots": kept}
        self._publish(base + 1, tables)
        self._prune()
        return base + 1

    def _publish(self, version: int, tables: dict) -> None:
        draft, final = self._path(f"_versions/.{uuid.uuid4().hex}"), self._path(f"_versions/{version:012d}.json")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        files = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf)
        kinds = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            files.rename(draft, final, kinds)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(e):
                raise Conflict(f"version {version} of {self.root} was published meanwhile") from None
            raise

    def _prune(self) -> None:
        """Deletes versions beyond the last `keep` and the folders that only they name."""
        versions = self.versions()
        old, stay = versions[: -self.keep], versions[-self.keep :]
        used = {f for v in stay for t in self.manifest(v).values() for f in t["slots"].values()}
        for v in old:
            for folder in {f for t in self.manifest(v).values() for f in t["slots"].values()} - used:
                self._fs.delete(self._path(folder), True)
            self._fs.delete(self._path(f"_versions/{v:012d}.json"), False)
