"""Title lists: gzipped TSV with a header, where \\N is null and an empty field is an empty string."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from millrace.errors import MetadataError
from millrace.operators.tables import Catalog, merge, now
from millrace.sources.releases import Fetch, total_size

BASE_URL = "https://datasets.imdbws.com/"
BASICS = ("title.basics.tsv.gz", ("tconst", "titleType", "primaryTitle", "originalTitle", "isAdult", "startYear", "endYear", "runtimeMinutes", "genres"))
EPISODES = ("title.episode.tsv.gz", ("tconst", "parentTconst", "seasonNumber", "episodeNumber"))


def rows(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """The rows as strings.  Not read.csv, which makes empty fields null and lets a stray quote swallow columns."""
    lines = spark.read.text(path)
    head = lines.head()
    if head is None or tuple(head.value.split("\t")) != columns:
        raise MetadataError(f"{path}: the header isn't {', '.join(columns)}")
    parts = lines.where(F.col("value") != "\t".join(columns)).select(F.split("value", "\t", -1).alias("p"))
    return parts.where(F.size("p") == len(columns)).select(*[F.nullif(F.col("p")[i], F.lit("\\N")).alias(c) for i, c in enumerate(columns)])


def basics(spark: SparkSession, path: str) -> DataFrame:
    r = rows(spark, path, BASICS[1])
    num = lambda c: F.col(c).try_cast("int")
    return r.select(
        F.col("tconst").alias("imdb_id"), F.col("titleType").alias("title_type"), F.col("primaryTitle").alias("primary_title"), F.col("originalTitle").alias("original_title"),
        num("startYear").alias("start_year"), num("endYear").alias("end_year"), (F.coalesce(num("isAdult"), F.lit(0)) != 0).alias("is_adult"), num("runtimeMinutes").alias("runtime_minutes"),
        F.lit("imdb_datasets").alias("source"), F.lit(now()).alias("imported_at"),
    ).where("imdb_id is not null").dropDuplicates(["imdb_id"])


def import_basics(catalog: Catalog, path: str) -> int:
    """Upsert by id; parents and episode numbers from an earlier import stay."""
    new = basics(catalog.spark, path)
    catalog.upsert("titles", new)
    return record(catalog, BASICS[0], path, new.count())


def import_episodes(catalog: Catalog, path: str) -> int:
    """Parent, season and episode of titles that are there already; basics come first."""
    if catalog.read("titles").isEmpty():
        raise MetadataError("episodes complete titles: import the basics first")
    r = rows(catalog.spark, path, EPISODES[1])
    num = lambda c: F.col(c).try_cast("int")
    new = r.select(F.col("tconst").alias("imdb_id"), F.col("parentTconst").alias("parent_imdb_id"), num("seasonNumber").alias("season_number"), num("episodeNumber").alias("episode_number")).dropDuplicates(["imdb_id"])
    known = new.join(catalog.read("titles").select("imdb_id"), "imdb_id", "left_semi")
    catalog.rewrite("titles", lambda old: merge(old, known, ["imdb_id"], ("parent_imdb_id", "season_number", "episode_number")))
    return record(catalog, EPISODES[0], path, known.count())


def record(catalog: Catalog, source: str, path: str, n: int) -> int:
    row = catalog.spark.range(1).select(F.xxhash64(F.lit(path), F.lit(str(now()))).alias("import_id"), F.lit(source).alias("source"), F.lit(path).alias("file_name"), F.lit(None).cast("string").alias("released_at"), F.lit(n).cast("long").alias("row_count"), F.lit(now()).alias("imported_at"))
    catalog.append("imports", row)
    return n


def with_parents(titles: DataFrame) -> DataFrame:
    """Titles with parent_title: one self-join for all."""
    parent = titles.select(F.col("imdb_id").alias("_p"), F.col("primary_title").alias("parent_title"))
    return titles.join(parent, titles["parent_imdb_id"] == parent["_p"], "left").drop("_p")


def resolve_many(titles: DataFrame, ids: DataFrame) -> DataFrame:
    """The titles of the ids, with parents; unknown ids are absent."""
    return with_parents(titles).join(ids.select("imdb_id").distinct(), "imdb_id", "left_semi")


def resolve(titles: DataFrame, imdb_id: str) -> Row | None:
    """One title with its parent's, by a filter that reaches the scan on both sides; None for an unknown id."""
    own = titles.where(F.col("imdb_id") == imdb_id)
    parents = titles.join(F.broadcast(own.select(F.col("parent_imdb_id").alias("imdb_id"))), "imdb_id", "left_semi")
    return own.join(parents.select(F.col("imdb_id").alias("_p"), F.col("primary_title").alias("parent_title")), F.col("parent_imdb_id") == F.col("_p"), "left").drop("_p").head()


def fetch(folder: Path, get: Fetch, force: bool = False) -> list[Path]:
    """The list files into a folder; those that are there stay, unless forced.  A file takes its name only when all of a
    reply with status 200 has come."""
    folder.mkdir(parents=True, exist_ok=True)
    out = []
    for name, _ in (BASICS, EPISODES):
        path, part = folder / name, folder / f"{name}.part"
        if force or not path.exists():
            r = get(BASE_URL + name, {})
            if r.status != 200:
                raise MetadataError(f"{BASE_URL}{name}: status {r.status}")
            whole, done = total_size(r.headers, 0), 0
            with part.open("wb") as f:
                for block in r.blocks():
                    done += f.write(block)
            if whole is not None and done != whole:
                raise MetadataError(f"{BASE_URL}{name}: {done} of {whole} bytes came")
            part.replace(path)
        out.append(path)
    return out
