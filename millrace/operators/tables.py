"""Catalog tables as versioned Parquet.

Each write makes a new part folder; then a numbered pointer file, which lists the table's parts, is published after the
pointer that the write was derived from.  Pointers are never overwritten or deleted by a write, and a number is taken
once, so a crash at any moment leaves the table as it was, and of two writers that start from one pointer the later fails
or starts again.  Reads take the pointer of the highest number and see one snapshot throughout.  Append-only tables (the
ledger) list more parts instead of rewriting; small parts are merged now and then, so each row is rewritten a logarithmic
number of times.  Keys are kept unique by the writer; deletes and cascades are anti-joins.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from millrace.errors import CatalogError, SchemaVersionError
from millrace.schema import CASCADES, KEYS, PARTITIONS, TABLES, VERSION

#: Bytes of a file that compaction aims at; parts below count as small, and so many small ones are merged.
FILE_BYTES, SMALL_PARTS = 128 << 20, 32
TRIES = 5
#: Pointers that vacuum keeps for readers that are under way.
POINTERS_KEPT = 4


class Catalog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- small files, by Hadoop's file system, so that any store works
    def _read(self, name: str) -> dict | None:
        p = self._path(f"{self.root}/{name}")
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, name: str, value: dict) -> bool:
        """The whole file under a name that isn't taken yet; false if it is.  Written beside first, so nobody reads a part."""
        tmp, to = self._path(f"{self.root}/_tmp-{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}")
        self._fs.mkdirs(to.getParent())
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if self._fs.getScheme() == "file":  # the local rename would overwrite; a link does not
            try:
                os.link(tmp.toUri().getPath(), to.toUri().getPath())
                return True
            except FileExistsError:
                return False
            finally:
                self._fs.delete(tmp, False)
        if not self._fs.exists(to) and self._fs.rename(tmp, to):
            return True
        self._fs.delete(tmp, False)
        return False

    # --- pointers
    def _numbers(self, name: str) -> list[int]:
        folder = self._path(f"{self.root}/{name}/_pointers")
        if not self._fs.exists(folder):
            return []
        return sorted(int(n[:-5]) for s in self._fs.listStatus(folder) if (n := s.getPath().getName()).endswith(".json"))

    def _pointer(self, name: str) -> tuple[int, list[dict]] | None:
        """The number of the newest pointer and the parts that it lists: path and bytes."""
        for _ in range(TRIES):
            if not (numbers := self._numbers(name)):
                return None
            if (got := self._read(f"{name}/_pointers/{numbers[-1]:012d}.json")) is not None:  # vacuum may have been faster
                return numbers[-1], got["parts"]
        raise CatalogError(f"{name}: the pointer can't be read")

    def _snapshot(self, name: str) -> tuple[int, list[dict]]:
        got = self._pointer(name)
        if got is None:
            raise CatalogError(f"{self.root}: no table {name}; initialise the catalog first")
        return got

    def _move(self, name: str, base: int, parts: list[dict]) -> bool:
        return self._publish(f"{name}/_pointers/{base + 1:012d}.json", {"parts": parts})

    def _changed(self, name: str, change: Callable[[list[dict]], tuple[list[dict] | None, Any]]) -> Any:
        """change(parts) gives the new parts, or None for no change, and a result; done anew where another writer came first."""
        for k in range(TRIES):
            base, parts = self._snapshot(name)
            new, result = change(parts)
            if new is None or self._move(name, base, new):
                return result
            time.sleep(0.1 * 2**k)
        raise CatalogError(f"{name}: other writers keep changing the table")

    # --- schema
    def version(self) -> int:
        if not self._fs.exists(self._path(self.root)):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return max([int(n[5:-5]) for n in names if n.startswith("meta-") and n.endswith(".json")] + [int("meta.json" in names)])

    def initialize(self) -> int:
        """Tables that lack; those that are there keep their rows, at whatever step an earlier call or write broke off."""
        have = self.version()
        if have not in (0, VERSION):
            raise SchemaVersionError(f"the catalog has schema {have}, this program knows {VERSION}")
        self._fs.mkdirs(self._path(self.root))
        for name in TABLES:
            if self._pointer(name) is None:
                self._move(name, -1, [])
        self._publish(f"meta-{VERSION}.json", {"schema_version": VERSION})
        return VERSION

    def ensure_current(self) -> None:
        have = self.version()
        if have == 0:
            raise CatalogError(f"{self.root}: no catalog; initialise it first")
        if have != VERSION:
            raise SchemaVersionError(f"the catalog has schema {have}, this program needs {VERSION}")

    # --- reads and writes
    def _frame(self, name: str, parts: list[dict]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], TABLES[name])
        paths = [f"{self.root}/{p['path']}" for p in parts]
        reader = self.spark.read.schema(TABLES[name])
        if name not in PARTITIONS:
            return reader.parquet(*paths)  # one scan, however many parts
        out = reader.parquet(paths[0])
        for p in paths[1:]:
            out = out.unionByName(reader.parquet(p))
        return out

    def read(self, name: str) -> DataFrame:
        return self._frame(name, self._snapshot(name)[1])

    def get(self, name: str, **key: Any) -> Row | None:
        """The row of a key, or of any other condition on columns; None where there is none."""
        return self._where(name, key).head()

    def count(self, name: str, **key: Any) -> int:
        return self._where(name, key).count()

    def _where(self, name: str, key: dict[str, Any]) -> DataFrame:
        d = self.read(name)
        for c, v in key.items():
            d = d.where(F.col(c).eqNullSafe(F.lit(v)))
        return d

    def _part(self, path: str) -> dict:
        return {"path": path, "bytes": self._fs.getContentSummary(self._path(f"{self.root}/{path}")).getLength()}

    def store_wave(self, df: DataFrame, by: str) -> dict[str, dict]:
        """Rows for several append-only tables, computed and written once: a part for each value of column by, as yet in no
        table."""
        path = f"waves/{uuid.uuid4().hex}"
        df.write.partitionBy(by).parquet(f"{self.root}/{path}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{path}"))]
        return {n.split("=", 1)[1]: self._part(f"{path}/{n}") for n in names if n.startswith(f"{by}=")}

    def frame_of(self, name: str, parts: list[dict]) -> DataFrame:
        return self._frame(name, parts)

    def _store(self, name: str, df: DataFrame) -> dict:
        path = f"{name}/{uuid.uuid4().hex}"
        w = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name]]).write
        if by := PARTITIONS.get(name):
            w = w.partitionBy(*by)
        w.parquet(f"{self.root}/{path}")
        return self._part(path)

    def replace(self, name: str, df: DataFrame) -> None:
        """A new content that doesn't derive from the old one."""
        part = self._store(name, df)
        self._changed(name, lambda parts: ([part], None))

    def rewrite(self, name: str, change: Callable[[DataFrame], DataFrame]) -> None:
        self._changed(name, lambda parts: ([self._store(name, change(self._frame(name, parts)))], None))

    def append(self, name: str, df: DataFrame) -> None:
        self.append_part(name, self._store(name, df))

    def append_part(self, name: str, part: dict) -> None:
        """A stored part becomes visible; small parts are merged once there are many."""

        def change(parts: list[dict]) -> tuple[list[dict], None]:
            parts = [*parts, part]
            small = [p for p in parts if p["bytes"] < FILE_BYTES]
            if len(small) >= SMALL_PARTS:
                parts = [*(p for p in parts if p["bytes"] >= FILE_BYTES), self._merged(name, small)]
            return parts, None

        self._changed(name, change)

    def _merged(self, name: str, parts: list[dict]) -> dict:
        files = max(1, -(-sum(p["bytes"] for p in parts) // FILE_BYTES))
        d = self._frame(name, parts)
        return self._store(name, d.coalesce(1) if files == 1 else d.repartition(files))

    def insert_missing(self, name: str, df: DataFrame, order: str | None = None) -> int:
        """First wins: rows whose key is stored already, or came earlier in df, are left out.  Returns the number added."""
        keys = list(KEYS[name])
        new = first_wins(df, keys, order)

        def change(parts: list[dict]) -> tuple[list[dict] | None, int]:
            part = self._store(name, new.join(self._frame(name, parts).select(*keys), keys, "left_anti"))
            added = self._frame(name, [part]).count()  # from the footers of what was written
            return ([*parts, part] if added else None), added

        return self._changed(name, change)

    def upsert(self, name: str, df: DataFrame, keep: tuple[str, ...] = ()) -> None:
        """Merge on the natural key; columns in keep hold their old value where the new one is null, or keep it outright
        where df lacks the column."""
        self.rewrite(name, lambda old: merge(old, df, list(KEYS[name]), keep))

    def delete(self, name: str, keys: DataFrame, on: list[str]) -> int:
        """The rows of the keys go, and with them what refers to them in other tables; returns how many went here."""
        keys = keys.select(*on).distinct()
        for child, column in CASCADES.get(name, ()):
            lost = keys if on == [column] else self.read(name).join(keys, on, "left_semi").select(column)
            self.delete(child, lost, [column])

        def change(parts: list[dict]) -> tuple[list[dict] | None, int]:
            old = self._frame(name, parts)
            gone = old.join(keys, on, "left_semi").count()
            return ([self._store(name, old.join(keys, on, "left_anti"))] if gone else None), gone

        return self._changed(name, change)

    def vacuum(self, analyze: bool = True, older_than: float = 3600.0) -> dict[str, int]:
        """Each table to one part of files of a good size.  Folders that no kept pointer names, and scratch files, are
        removed once they are older_than seconds old, so what a running job reads or writes stays."""
        self.ensure_current()
        before, out, live = (time.time() - older_than) * 1000, {}, set()
        for name in TABLES:
            self._changed(name, lambda parts, name=name: (None, None) if len(parts) < 2 else ([self._merged(name, parts)], None))
            numbers = self._numbers(name)
            for n in numbers[:-POINTERS_KEPT]:
                self._drop(f"{name}/_pointers/{n:012d}.json", before)
            kept = [self._read(f"{name}/_pointers/{n:012d}.json") for n in numbers[-POINTERS_KEPT:]]
            live |= {"/".join(p["path"].split("/")[:2]) for k in kept if k for p in k["parts"]}
            out[name] = self.read(name).count() if analyze else -1
        for s in self._fs.listStatus(self._path(self.root)):
            top = s.getPath().getName()
            if top.startswith("_"):
                self._drop(top, before)
            elif top in TABLES or top == "waves":
                for f in self._fs.listStatus(s.getPath()):
                    if (folder := f"{top}/{f.getPath().getName()}") not in live and not folder.endswith("/_pointers"):
                        self._drop(folder, before)
        return out

    def _drop(self, path: str, before: float) -> None:
        p = self._path(f"{self.root}/{path}")
        if self._fs.exists(p) and self._fs.getFileStatus(p).getModificationTime() <= before:
            self._fs.delete(p, True)

    def status(self) -> dict[str, int]:
        return {"schema_version": self.version()} | {t: self.read(t).count() for t in TABLES}


def now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None, microsecond=0)


def first_wins(df: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row per key: of least order, or any.  An aggregate rather than a window: repeats combine before the shuffle."""
    if order is None:
        return df.dropDuplicates(keys)
    rest = [c for c in df.columns if c not in (*keys, order)]
    return df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_m")).select(*keys, "_m.*").select(*df.columns)


def merge(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"o.{c}")
        return F.coalesce(f"n.{c}", f"o.{c}") if c in keep or c in keys else F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    return o.join(n, on, "full_outer").select(*[value(c).alias(c) for c in old.columns])


def changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): new, missing or changed values; a null old value is a first value and no change."""
    both = old.select(key, F.col(value).alias("_o"), F.lit(1).alias("_ho")).join(new.select(key, F.col(value).alias("_n"), F.lit(1).alias("_hn")), key, "full_outer")
    kind = F.when(F.col("_ho").isNull(), "new").when(F.col("_hn").isNull(), "missing").when(F.col("_o").isNotNull() & ~F.col("_o").eqNullSafe(F.col("_n")), "changed")
    return both.select(key, kind.alias("change")).where("change is not null")


def progress(rows: DataFrame, statuses: tuple[str, ...], status: str = "status", name: str = "files") -> DataFrame:
    """Rows by status, statuses without rows included."""
    s = rows.sparkSession
    every = s.range(1).select(F.explode(F.array(*map(F.lit, statuses))).alias(status))
    return every.join(rows.groupBy(status).agg(F.count("*").alias(name)), status, "left").select(status, F.coalesce(name, F.lit(0)).cast("long").alias(name))


def ordered_downloads(catalog: Catalog) -> DataFrame:
    return catalog.read("downloads").orderBy(F.desc_nulls_last("downloaded_at"), F.desc("download_id"))


def mark_download(catalog: Catalog, download_id: int, status: str, sha256: str | None = None, archive_path: str | None = None, verified: bool = False) -> None:
    """A status change: known hash and path stay; an unknown id does nothing."""
    own, stamp = F.col("download_id") == download_id, F.lit(now())
    fresh = {"status": F.lit(status), "sha256": F.coalesce(F.lit(sha256), "sha256"), "archive_path": F.coalesce(F.lit(archive_path), "archive_path")}
    fresh |= ({"downloaded_at": stamp} if status == "downloaded" else {}) | ({"verified_at": stamp} if verified else {})
    catalog.rewrite("downloads", lambda d: d.withColumns({c: F.when(own, v).otherwise(F.col(c)) for c, v in fresh.items()}))
