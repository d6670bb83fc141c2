"""Tables that change together: versions of Parquet parts under one folder, and a manifest that is switched last.

A table is a set of named parts, each a folder of Parquet files that is written once. A draft writes new parts beside the old ones and takes effect by one new manifest;
until then, and for ever if it fails, readers see the old version whole. A manifest's number is taken by creating its file, so of two drafts on one version the second fails.
All files are reached through Spark's own file systems, so the folder may be anywhere that the cluster reaches.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Store:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """``version``, ``tables`` (table -> part -> folder) and ``facts`` of the newest version, or of a given one; the empty version 0 where nothing is stored."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "tables": {}, "facts": {}}
        stream = self._fs.open(self._path(f"{self.folder}/manifest-{version or versions[-1]:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, table: str, parts: list[str] | None = None, version: int | None = None) -> DataFrame | None:
        """A table, or some parts of it; None where there are none."""
        known = self.manifest(version)["tables"].get(table, {})
        folders = [f"{self.folder}/{known[p]}" for p in (sorted(known) if parts is None else parts) if p in known]
        return self.spark.read.parquet(*folders) if folders else None

    def begin(self) -> Draft:
        return Draft(self)

    def clean(self, keep: int = 2) -> None:
        """Deletes all versions but the ``keep`` newest, and the parts that none of these names (those of failed drafts too, so no draft may be open)."""
        versions = self._versions()
        named = {folder.split("/")[0] for v in versions[-keep:] for parts in self.manifest(v)["tables"].values() for folder in parts.values()}
        for status in self._fs.listStatus(self._path(self.folder)) if versions else []:
            name = status.getPath().getName()
            if name not in named and (name.startswith("parts-") or name in {f"manifest-{v:08d}.json" for v in versions[:-keep]}):
                self._fs.delete(status.getPath(), True)


class Draft:
    """Changes to a store; nothing is seen before ``commit``."""

    def __init__(self, store: Store) -> None:
        self.store, now = store, store.manifest()
        self.version, self.tables, self.facts = now["version"] + 1, {t: dict(p) for t, p in now["tables"].items()}, dict(now["facts"])
        self.folder = f"parts-{self.version:08d}-{uuid.uuid4().hex[:12]}"

    def put(self, table: str, part: str, df: DataFrame) -> DataFrame:
        """Writes a part, which replaces the one of that name; what was written, read back."""
        place = f"{self.folder}/{table}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.store.folder}/{place}")
        self.tables.setdefault(table, {})[part] = place
        return self.store.spark.read.parquet(f"{self.store.folder}/{place}")

    def drop(self, table: str, part: str | None = None) -> None:
        """Leaves out a part, or all of a table."""
        if part is None:
            self.tables.pop(table, None)
        else:
            self.tables.get(table, {}).pop(part, None)

    def commit(self) -> int:
        """Makes this the store's version, and gives its number; fails if another draft did so since ``begin``."""
        fs, path = self.store._fs, self.store._path
        text = json.dumps({"version": self.version, "tables": self.tables, "facts": self.facts}, sort_keys=True)
        target = path(f"{self.store.folder}/manifest-{self.version:08d}.json")
        draft = path(f"{self.store.folder}/{self.folder}/manifest.json")
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            raise RuntimeError(f"version {self.version} of {self.store.folder} exists")
        return self.version
