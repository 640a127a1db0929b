"""Corpus archives: a zip that is never extracted, as a batch source with one partition per range of members.

No process holds the names of all members: the driver walks the archive's directory to cut it into ranges, a task reads its
range of it, and members that are asked for by name meet their directory records in a join.
"""

from __future__ import annotations

import io
import os
import shutil
import struct
import uuid
import zipfile
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition
from pyspark.sql.types import BinaryType, StructField, StructType

from millrace.errors import ArchiveError
from millrace.functions.text import parsed_path

SUFFIX = ".xml"
#: Bytes of members that are passed on together, or one member; and bytes that are read or copied at a time.
BATCH_BYTES, BLOCK = 4 << 20, 4 << 20
#: The fixed part of a directory record, and where in it the lengths of its name, extra field and comment are.
RECORD, LENGTHS = 46, struct.Struct("<28x3H")


def _end(f: io.BufferedIOBase) -> tuple[int, int, int, int]:
    """Where the directory begins, its bytes, its records, and what is to be added to the places that it names."""
    end = zipfile._EndRecData(f)  # noqa: SLF001
    if not end:
        raise zipfile.BadZipFile("no end of a directory")
    size, offset, at = end[zipfile._ECD_SIZE], end[zipfile._ECD_OFFSET], end[zipfile._ECD_LOCATION]  # noqa: SLF001
    if end[zipfile._ECD_SIGNATURE] == zipfile.stringEndArchive64:  # noqa: SLF001
        at -= zipfile.sizeEndCentDir64 + zipfile.sizeEndCentDir64Locator
    if at < size + offset:
        raise zipfile.BadZipFile("the directory isn't whole")
    return at - size, size, end[zipfile._ECD_ENTRIES_TOTAL], at - size - offset  # noqa: SLF001


def _records(f: io.BufferedIOBase, at: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """The directory records from at to stop, each with its place."""
    held, i = b"", 0
    f.seek(at)
    while at < stop:
        while len(held) - i < RECORD or len(held) - i < RECORD + sum(LENGTHS.unpack_from(held, i)):
            more = f.read(min(BLOCK, stop - at - (len(held) - i)))
            if not more:
                raise zipfile.BadZipFile("the directory breaks off")
            held, i = held[i:] + more, 0
        if held[i : i + 4] != zipfile.stringCentralDir:
            raise zipfile.BadZipFile("not a directory record")
        n = RECORD + sum(LENGTHS.unpack_from(held, i))
        yield at, held[i : i + n]
        at, i = at + n, i + n


def _end_records(at: int, size: int, count: int, shift: int = 0) -> bytes:
    """What follows a directory that begins at at."""
    end64 = struct.pack("<4sQ2H2L4Q", zipfile.stringEndArchive64, 44, 45, 45, 0, 0, count, count, size, at - shift)
    locator = struct.pack("<4sLQL", zipfile.stringEndArchive64Locator, 0, at + size - shift, 1)
    return end64 + locator + struct.pack("<4s4H2LH", zipfile.stringEndArchive, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)


class _Part(io.RawIOBase):
    """The archive as if its directory held some of its records only."""

    def __init__(self, f: io.BufferedIOBase, at: int, shift: int, records: list[bytes]) -> None:
        own = b"".join(records)
        self.f, self.start, self.tail, self.at = f, at, own + _end_records(at, len(own), len(records), shift), 0

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = max(0, offset + (0, self.at, self.start + len(self.tail))[whence])
        return self.at

    def readinto(self, out: bytearray) -> int:
        if self.at < self.start:
            self.f.seek(self.at)
            got = self.f.read(min(len(out), self.start - self.at))
        else:
            got = self.tail[self.at - self.start : self.at - self.start + len(out)]
        out[: len(got)] = got
        self.at += len(got)
        return len(got)


def check_archive(path: str) -> None:
    """Fails before any job: a missing file, and one that isn't a whole zip."""
    if not Path(path).is_file():
        raise ArchiveError(f"{path}: no such archive")
    try:
        with open(path, "rb") as f:
            at, size, count, _ = _end(f)
            if sum(1 for _ in _records(f, at, at + size)) != count:
                raise zipfile.BadZipFile("the directory has another number of records than it says")
    except (zipfile.BadZipFile, OSError) as e:
        raise ArchiveError(f"{path}: not a readable zip: {e}") from e


class MemberRange(InputPartition):
    """Directory records from at to stop."""

    def __init__(self, at: int, stop: int) -> None:
        self.at, self.stop = at, stop


class ZipReader(DataSourceReader):
    def __init__(self, path: str, partitions: int, content: bool, record: bool) -> None:
        self.path, self.most, self.content, self.record, self.only = path, partitions, content, record, None

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("rel_path",):
                self.only = f.value
            else:
                yield f

    def partitions(self) -> list[MemberRange]:  # type: ignore[override]
        with open(self.path, "rb") as f:
            at, size, count, shift = _end(f)
            every = _records(f, at, at + size)
            if self.only is not None:  # of several members of one name the last counts, so it comes first
                wanted = {self.only.encode(), self.only.encode("cp437", "replace")}
                found = [MemberRange(i, i + len(x)) for i, x in every if x[RECORD : RECORD + LENGTHS.unpack_from(x)[0]] in wanted]
                return found[::-1] or [MemberRange(at, at)]
            step = -(-count // max(1, min(self.most, count)))
            edges = [i for k, (i, _) in enumerate(every) if k % step == 0]
            return [MemberRange(i, k) for i, k in zip(edges, [*edges, at + size][1:], strict=True)] or [MemberRange(at, at)]

    def read(self, partition: MemberRange) -> Iterator[pa.RecordBatch]:
        kinds = [("rel_path", pa.string()), ("size", pa.int64()), ("compressed_size", pa.int64()), ("content", pa.binary())] + ([("place", pa.int64()), ("record", pa.binary())] if self.record else [])
        with open(self.path, "rb") as f:
            at, _, _, shift = _end(f)
            found = list(_records(f, partition.at, partition.stop))
            rows, held = [], 0
            with zipfile.ZipFile(io.BufferedReader(_Part(f, at, shift, [x for _, x in found]))) as z:
                for (place, record), i in zip(found, z.infolist(), strict=True):
                    if i.is_dir() or self.only is not None and i.filename != self.only:
                        continue
                    rows.append((i.filename, i.file_size, i.compress_size, z.read(i) if self.content else None, place, record)[: len(kinds)])
                    held += RECORD + (i.file_size if self.content else 0) + len(record)
                    if held >= BATCH_BYTES:
                        yield _batch(rows, kinds)
                        rows, held = [], 0
            if rows:
                yield _batch(rows, kinds)


def _batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])


class ZipCorpus(DataSource):
    """spark.read.format('zipcorpus').option('path', ...): rel_path, size, compressed_size, content; with option record=true
    also a member's record in the directory and where this is.  Members are only decompressed with option content=true."""

    @classmethod
    def name(cls) -> str:
        return "zipcorpus"

    def _is(self, option: str) -> bool:
        return self.options.get(option, "false").lower() == "true"

    def schema(self) -> str:
        return "rel_path string, size long, compressed_size long, content binary" + (", place long, record binary" if self._is("record") else "")

    def reader(self, schema) -> ZipReader:  # noqa: ANN001
        return ZipReader(self.options["path"], int(self.options.get("partitions", "64")), self._is("content"), self._is("record"))


def _source(spark: SparkSession, path: str, partitions: int = 64, **options: bool) -> DataFrame:
    check_archive(path)
    path = str(Path(path).resolve())  # tasks have working folders of their own
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # for the lookup of one member by name
    spark.dataSource.register(ZipCorpus)
    return spark.read.format("zipcorpus").option("path", path).option("partitions", str(partitions)).options(**{k: str(v).lower() for k, v in options.items()}).load()


def members(spark: SparkSession, path: str, content: bool = False, partitions: int = 64, every: bool = False) -> DataFrame:
    """The subtitle members of an archive, or with every all files; directories never."""
    d = _source(spark, path, partitions, content=content)
    return d if every else d.where(F.col("rel_path").endswith(SUFFIX))


def open_member(spark: SparkSession, path: str, rel_path: str) -> bytes:
    got = members(spark, path, content=True).where(F.col("rel_path") == rel_path).select("content").head()
    if got is None:
        raise ArchiveError(f"{path}: missing member {rel_path}")
    return bytes(got.content)


def placed(files: DataFrame, path: str) -> DataFrame:
    """files with zip_record: the directory record of the member that rel_path names, null for a name that the archive lacks.  Of
    several members of one name the last counts."""
    known = _source(files.sparkSession, path, record=True).groupBy("rel_path").agg(F.max_by("record", "place").alias("zip_record"))
    return files.join(known, "rel_path", "left").select(*files.columns, "zip_record")


def contents(files: DataFrame, path: str) -> DataFrame:
    """files with content: the members that their rel_path names, each read by its place in the archive, which every
    executor must be able to open.  What isn't named is not read; null for a name that the archive lacks.  Files that are placed
    already are read as they are, without the archive's directory."""
    check = Path(path).resolve()
    if "zip_record" not in files.columns:
        files = placed(files, path)
    elif not check.is_file():
        raise ArchiveError(f"{path}: no such archive")
    path = str(check)
    kept = StructType([f for f in files.schema.fields if f.name != "zip_record"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as f:
            at, _, _, shift = _end(f)
            for b in batches:
                records, own = b.column("zip_record").to_pylist(), b.select(kept.names)
                different = [x for x in dict.fromkeys(records) if x is not None]
                with zipfile.ZipFile(io.BufferedReader(_Part(f, at, shift, different))) as z:
                    infos, got, held, first = dict(zip(different, z.infolist(), strict=True)), [], 0, 0
                    for i, x in enumerate(records):
                        got.append(None if x is None else z.read(infos[x]))
                        held += len(got[-1] or b"")
                        if held >= BATCH_BYTES or i == len(records) - 1:
                            yield pa.RecordBatch.from_arrays([*own.slice(first, len(got)).columns, pa.array(got, pa.binary())], [*kept.names, "content"])
                            got, held, first = [], 0, i + 1

    return files.mapInArrow(run, StructType([*kept.fields, StructField("content", BinaryType())]))


def _record(i: zipfile.ZipInfo) -> bytes:
    """A directory record with its place in the file in the extra field, so that its length does not depend on it; the place comes last
    there, after sizes that need room as well."""
    name, flag = i._encodeFilenameFlags()  # noqa: SLF001
    wide = [x for x in (i.file_size, i.compress_size) if x >= 0xFFFFFFFF]
    extra = struct.pack(f"<2H{len(wide) + 1}Q", 1, 8 * (len(wide) + 1), *wide, i.header_offset)
    y, mo, d, h, mi, sec = i.date_time
    return struct.pack(
        "<4s4B4HL2L5H2L", zipfile.stringCentralDir, 45, i.create_system, 45, 0, flag, i.compress_type, h << 11 | mi << 5 | sec // 2, (y - 1980) << 9 | mo << 5 | d,
        i.CRC, min(i.compress_size, 0xFFFFFFFF), min(i.file_size, 0xFFFFFFFF), len(name), len(extra), 0, 0, i.internal_attr, i.external_attr, 0xFFFFFFFF,
    ) + name + extra


def written(rows: DataFrame, path: str, first: tuple[str, ...] = ()) -> None:
    """A zip of rows(rel_path, content), after empty members named in first, on a file system that driver and executors share.
    Each task packs its rows into a part; the parts are then copied to their places in the archive, again by tasks.  Only the
    parts' sizes come to the driver."""
    folder = f"{path}-{uuid.uuid4().hex}"
    os.makedirs(folder)

    def pack(name: str, members: Iterator[tuple[str, bytes]]) -> tuple[str, int, int, int]:
        with zipfile.ZipFile(f"{folder}/{name}", "w", zipfile.ZIP_DEFLATED) as z, open(f"{folder}/{name}.dir", "wb") as d:
            for rel_path, content in members:
                z.writestr(rel_path, content)
                d.write(_record(z.filelist.pop()))
                z.NameToInfo.clear()
            return name, z.start_dir, d.tell(), 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0

        def members() -> Iterator[tuple[str, bytes]]:
            nonlocal n
            for b in batches:
                for i in range(b.num_rows):
                    n += 1
                    yield b.column(0)[i].as_py(), b.column(1)[i].as_py()

        name, size, records, _ = pack(uuid.uuid4().hex, members())
        yield pa.RecordBatch.from_pydict({"name": [name], "size": [size], "records": [records], "n": [n]})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = os.open(path, os.O_WRONLY)
        try:
            for b in batches:
                for x in b.to_pylist():
                    at, left = x["at"], x["size"]
                    with open(f"{folder}/{x['name']}", "rb") as f:
                        while left:
                            block = f.read(min(BLOCK, left))
                            os.pwrite(out, block, at)
                            at, left = at + len(block), left - len(block)
                    at = x["dir_at"]
                    with open(f"{folder}/{x['name']}.dir", "rb") as f:
                        for _, record in _records(f, 0, x["records"]):
                            own = int.from_bytes(record[-8:], "little") + x["at"]
                            os.pwrite(out, record[:-8] + own.to_bytes(8, "little"), at)
                            at += len(record)
            os.fsync(out)
            yield pa.RecordBatch.from_pydict({"done": [True]})
        finally:
            os.close(out)

    try:
        head = pack("first", ((x, b"") for x in first))[:3]
        parts = [(*head, len(first)), *rows.select("rel_path", F.col("content").cast("binary")).mapInArrow(run, "name string, size long, records long, n long").collect()]
        at, dir_at, todo = 0, sum(p[1] for p in parts), []
        start, size = dir_at, sum(p[2] for p in parts)
        for name, data, records, _ in parts:
            todo.append((name, data, records, at, dir_at))
            at, dir_at = at + data, dir_at + records
        with open(path, "wb") as f:
            f.truncate(start + size)
            f.seek(start + size)
            f.write(_end_records(start, size, sum(p[3] for p in parts)))
        spark = rows.sparkSession
        tasks = spark.createDataFrame(todo, "name string, size long, records long, at long, dir_at long").repartition(len(todo))
        tasks.mapInArrow(place, "done boolean").count()
    finally:
        shutil.rmtree(folder)


def entries(spark: SparkSession, path: str, language: str | None = None, content: bool = False) -> DataFrame:
    """Members with their parsed paths; names that don't parse are left out, and rejected() counts them."""
    d = members(spark, path, content).withColumn("e", parsed_path(F.col("rel_path"))).where("e is not null").select("*", "e.*").drop("e")
    return d if language is None else d.where(F.col("language") == language)


def rejected(spark: SparkSession, path: str) -> int:
    return members(spark, path).where(parsed_path(F.col("rel_path")).isNull()).count()


def summary(paths: DataFrame, sample_size: int = 5, suffix: str = SUFFIX, order: str | None = None) -> DataFrame:
    """One row: counts of subtitle, extensionless and other files of rel_path, and the first names of each by order."""
    name = F.regexp_extract("rel_path", "([^/]*)$", 1)
    kind = F.when(F.col("rel_path").endswith(suffix), "subtitle").when(~name.contains("."), "metadata").otherwise("unexpected")
    d = paths.withColumn("_k", kind)
    counts = [F.count_if(F.col("_k") == k).alias(f"{k}_count") for k in ("subtitle", "metadata", "unexpected")]
    if order is None:
        return d.agg(*counts)
    # the first names of each kind: a limit per kind keeps sample_size rows a task, whatever the number of members
    kinds = ("subtitle", "metadata", "unexpected")
    top = reduce(DataFrame.unionByName, [d.where(F.col("_k") == k).orderBy(order).limit(sample_size).select("_k", F.col(order).alias("_o"), "rel_path") for k in kinds])
    named = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("_k") == k, F.struct("_o", "rel_path")))), lambda x: x["rel_path"]).alias(f"{k}_sample")
    return d.agg(*counts).crossJoin(top.agg(*map(named, kinds)))  # one row beside one row
