"""Tables kept in buckets of their key, so that a merge reads and writes only the buckets that its keys fall into."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from weblake.sources.versions import listed, put_mark

_READY = "_READY"
_BUCKET = "bucket_no"
#: A bucket that is in more folders than this is written anew by the merge that next touches it.
MOST_FOLDERS = 16


@dataclass(frozen=True)
class Change:
    """New rows of a table. ``combine(old, new)`` gives a bucket's rows after them or, where ``appends``, the rows to add."""

    new: DataFrame
    keys: Sequence[str]
    combine: Callable[[DataFrame | None, DataFrame], DataFrame]
    appends: bool = False


class BucketStore:
    """Versions of a set of tables below ``root``.

    A version is a manifest: for every table and bucket, the folders that hold its rows. Folders are never
    written to again, so readers of a version are not disturbed, and a merge that fails leaves files that no
    manifest names. One writer at a time. The number of buckets is fixed by the first merge.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root, buckets

    def versions(self) -> list[int]:
        found = listed(self.spark, f"{self.root}/manifest/version=*/{_READY}")
        return sorted(int(path.split("/version=")[1].split("/")[0]) for path in found)

    def manifest(self, number: int | None = None) -> dict[str, dict[int, list[str]]]:
        """Table → bucket → folders of a version, the latest by default; the size is tables times buckets times MOST_FOLDERS at most."""
        ready = self.versions()
        number = (ready[-1] if ready else None) if number is None else number
        if number not in ready:
            return {}
        out: dict[str, dict[int, list[str]]] = {}
        for row in self.spark.read.parquet(f"{self.root}/manifest/version={number}").collect():
            table = out.setdefault(row.name, {})
            if row.folder is not None:
                table.setdefault(row.bucket, []).append(row.folder)
            self.buckets = row.buckets
        return out

    def _rows(self, name: str, folders: Sequence[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{folder}" for folder in folders))

    def _schema(self, name: str):
        """The schema a table was first written with."""
        path = sorted(listed(self.spark, f"{self.root}/schema/{name}"))
        return self.spark.read.parquet(path[0]).schema if path else None

    def read(self, name: str, number: int | None = None) -> DataFrame | None:
        table = self.manifest(number).get(name)
        if table is None:
            return None
        folders = sorted({folder for found in table.values() for folder in found})
        schema = self._schema(name)
        return self._rows(name, folders, schema) if folders else self.spark.createDataFrame([], schema)

    def tables(self, number: int | None = None) -> dict[str, DataFrame]:
        return {name: self.read(name, number) for name in self.manifest(number)}

    def merge(self, changes: dict[str, Change]) -> int:
        """Merge all changes into the latest version and make the next one; tables without a change stay."""
        ready = self.versions()
        number = (ready[-1] if ready else 0) + 1
        manifest = self.manifest()
        for name, change in changes.items():
            manifest[name] = self._merged(name, change, manifest.get(name), number)
        rows = [(name, bucket, folder, self.buckets) for name, table in manifest.items()
                for bucket, folders in table.items() for folder in folders]
        rows += [(name, None, None, self.buckets) for name, table in manifest.items() if not table]
        path = f"{self.root}/manifest/version={number}"
        self.spark.createDataFrame(rows, "name string, bucket int, folder string, buckets int").coalesce(1).write.mode("overwrite").parquet(path)
        put_mark(self.spark, f"{path}/{_READY}")
        return number

    def _merged(self, name: str, change: Change, table: dict[int, list[str]] | None, number: int) -> dict[int, list[str]]:
        bucket = F.pmod(F.xxhash64(*change.keys), F.lit(self.buckets)).cast("int")
        part = f"data/{name}/version={number}"
        new = change.new.withColumn(_BUCKET, bucket)
        touched = [row[0] for row in new.select(_BUCKET).distinct().collect()]  # at most as many as there are buckets
        table = dict(table or {})
        full = [b for b in touched if len(table.get(b, ())) >= MOST_FOLDERS]
        folders = sorted({f for b in touched for f in table.get(b, ())})
        old = self._rows(name, folders, self._schema(name)) if folders else None
        out = change.combine(old, change.new)
        if change.appends and full:
            whole = self._rows(name, sorted({f for b in full for f in table[b]}), self._schema(name))
            out = out.unionByName(whole.select(*out.columns))
        if self._schema(name) is None:
            out.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/schema/{name}")
        placed = out.withColumn(_BUCKET, bucket).repartitionByRange(_BUCKET, *change.keys)
        placed.write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.root}/{part}")
        written = {int(path.rsplit("=", 1)[1]): path for path in listed(self.spark, f"{self.root}/{part}/{_BUCKET}=*")}
        for b in touched:
            keep = table.get(b, []) if change.appends and b not in full else []
            table[b] = [*keep, *([f"{part}/{_BUCKET}={b}"] if b in written else [])]
        return {b: found for b, found in table.items() if found}
