"""Queries that go through the engine itself: a catalog filled from the driver tables, an archive, title lists, a search
with a deterministic client, and what they leave behind, each with the SQL that gives the same rows.

Catalogs lie in the shared folder that the cluster names.  One that is filled, and what a whole run leaves, is made once a
session and directory; queries that change one work on a copy of their own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import search, tables
from millrace.plans import manifest
from millrace.plans.catalogue import _t, files, titles
from millrace.schema import RUN_STATUSES, TABLES
from millrace.sources import releases, titles_tsv, zip_corpus
from millrace.streaming.files import arrivals, drain

RELEASE = "v1"
SOURCE = """name: flows
model: stand-in
select: {languages: [en, fr]}
chunk: {size: 8, overlap: 2}
prefilter: {mode: any, patterns: [license, ation]}
prompt: {user: "{{ imdb_id }} {{ chunk }}"}
output: {schema: {type: object, properties: {matched: {type: boolean}, n: {type: integer, minimum: 0}}, required: [matched, n], additionalProperties: false}}
match_when: matched
"""
LIMIT = 20


def scratch(spark: SparkSession) -> str:
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared}/millrace-{uuid.uuid4().hex}"


def local_folder(spark: SparkSession) -> Path:
    """The scratch folder for what can only be written as a local file; of no use where executors don't share it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark)).toUri()
    folder = Path(where.getPath())
    folder.mkdir(parents=True, exist_ok=True)
    return folder


class StandIn:
    """Says whether the text has 'license', and how long the prompt was; with fails, breaks on prompts of some lengths."""

    def __init__(self, fails: bool = False) -> None:
        self.fails = fails

    def complete(self, *, model: str, user: str, system: str | None = None, options: dict | None = None, json_schema: dict | None = None) -> search.Completion:
        if self.fails and len(user) % 5 == 0:
            raise RuntimeError("no answer")
        return search.Completion(json.dumps({"matched": "license" in user.lower(), "n": len(user)}), model, 1)


def members(s: SparkSession, d: str) -> DataFrame:
    """The files as an archive lists them."""
    return files(s, d).select("rel_path", text.parsed_path(F.col("rel_path")).alias("e"), F.octet_length("text").cast("long").alias("size"), F.col("text").cast("binary").alias("content")).select("rel_path", "size", "content", "e.*")


_made: dict[tuple, str] = {}


def _once(s: SparkSession, d: str, what: str, make: Callable[[], tables.Catalog]) -> tables.Catalog:
    """What make gives, or what it gave before in this session, if it is still there."""
    key = (s.sparkContext.applicationId, d, what)
    if key in _made and (c := tables.Catalog(s, _made[key])).version():
        return c
    c = make()
    _made[key] = c.root
    return c


def copied(c: tables.Catalog) -> tables.Catalog:
    own, conf = scratch(c.spark), c.spark._jsc.hadoopConfiguration()
    c.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(c._fs, c._path(c.root), c._fs, c._path(own), False, conf)
    return tables.Catalog(c.spark, own)


def filled(s: SparkSession, d: str) -> tables.Catalog:
    """A catalog of the files, with hashes, and the titles."""

    def make() -> tables.Catalog:
        c = tables.Catalog(s, scratch(s))
        c.initialize()
        search.index_files(c, members(s, d), RELEASE, rehash=True)
        t = titles(s, d).withColumns({"source": F.lit("driver"), "imported_at": F.lit(tables.now()), "end_year": F.lit(None).cast("int"), "runtime_minutes": F.lit(None).cast("int")})
        c.insert_missing("titles", t)
        return c

    return copied(_once(s, d, "filled", make))


def searched(s: SparkSession, d: str, fails: bool = False) -> tables.Catalog:
    """What a whole run leaves, to be read; run 1."""

    def make() -> tables.Catalog:
        c = filled(s, d)
        engine(s, d, c, fails).start(manifest.parse(SOURCE))
        return c

    return _once(s, d, f"searched {fails}", make)


def begun(s: SparkSession, d: str) -> tables.Catalog:
    """What a run over the first LIMIT files leaves, to be read; run 1."""

    def make() -> tables.Catalog:
        c = filled(s, d)
        engine(s, d, c).start(manifest.parse(SOURCE), limit=LIMIT)
        return c

    return _once(s, d, "begun", make)


def engine(s: SparkSession, d: str, c: tables.Catalog, fails: bool = False) -> search.Engine:
    texts = files(s, d).select("rel_path", "text")
    return search.Engine(c, lambda: StandIn(fails), lambda f: text.plain_sentences(f).drop("text"), concurrency=8, placed=lambda f: f.join(texts, "rel_path", "left"))


def by_path(c: tables.Catalog, rows: DataFrame, *columns: object) -> DataFrame:
    return rows.join(c.read("subtitle_files").select("file_id", "rel_path", "imdb_id"), "file_id").select("rel_path", *columns)


def answers(c: tables.Catalog) -> DataFrame:
    n = F.coalesce(F.get_json_object("payload", "$.n").cast("long"), F.lit(-1)).alias("n")
    return by_path(c, c.read("ledger").where("kind <> 'empty'"), "chunk_index", "kind", "first_sentence_index", "last_sentence_index", "first_sentence_id", "last_sentence_id", "last_chunk", "matched", n)


def q_engine_start(s, d):
    return answers(searched(s, d))


def q_engine_failures(s, d):
    c = searched(s, d, fails=True)
    return by_path(c, c.read("failures"), "chunk_index", "error")


def q_engine_resume(s, d):
    """A run over a few files with failing calls, then one over all, then the rest: one ledger row per chunk."""
    c = filled(s, d)
    run = engine(s, d, c, fails=True).start(manifest.parse(SOURCE), limit=LIMIT).run_id
    engine(s, d, c, fails=True).resume(run)
    engine(s, d, c).resume(run)
    return answers(c)


def q_engine_file_status(s, d):
    c = searched(s, d, fails=True)
    return by_path(c, search.run_files(c, 1), "status", F.coalesce("chunks_done", F.lit(0)).alias("chunks_done"), F.coalesce("last_sentence_index", F.lit(-1)).alias("last_sentence_index"), "error")


def q_engine_progress(s, d):
    return search.run_progress(searched(s, d, fails=True), 1)


def q_engine_outcome(s, d):
    c = searched(s, d)
    out = search.summary(c, 1)
    done, queued = search.plan_size(c, out.run_id)
    row = (out.files_done, out.chunks_done, out.chunks_skipped, out.matches, done, queued, c.count("ledger", kind="result", run_id=out.run_id), search.results(c, out.run_id, matched_only=True).count(), c.get("runs", run_id=out.run_id).status)
    return s.createDataFrame([row], "files_done long, chunks_done long, chunks_skipped long, matches long, plan_done long, plan_files long, results long, matched_results long, status string")


def q_engine_export(s, d):
    dest = f"{scratch(s)}/export"
    n = search.export_run(searched(s, d), 1, dest)
    rows = s.read.schema("imdb_id string, title string, year int, rel_path string, chunk_index long, first_sentence_index long, last_sentence_index long, first_sentence_id string, last_sentence_id string, matched boolean, payload struct<matched: boolean, n: long>, model string").json(dest)
    return rows.select("*", F.col("payload.n").alias("n"), F.lit(n).cast("long").alias("lines")).drop("payload")


def q_engine_enqueue(s, d):
    c = filled(s, d)
    select = manifest.parse(SOURCE).manifest.select
    first, again = search.enqueue(c, 1, select), search.enqueue(c, 1, select)
    counts = {"added": first.files, "unresolved": first.unresolved, "again": again.files}
    return by_path(c, c.read("run_files"), *[F.lit(v).cast("long").alias(k) for k, v in counts.items()])


def q_engine_work(s, d):
    """Unfinished files by path, the first ones, after a run over some."""
    return search.iter_work(begun(s, d), 1, 25).select("rel_path", "status")


def q_engine_refresh(s, d):
    c, run = copied(searched(s, d)), 1
    old = c.read("subtitle_files").select("file_id", "subtitle_id", "sha256")
    search.refresh(c, old.select("file_id", F.when(F.col("subtitle_id").cast("long") % 7 == 0, F.lit("other")).otherwise(F.col("sha256")).alias("sha256")))
    return by_path(c, search.run_files(c, run), "status", F.lit(c.get("runs", run_id=run).status).alias("run_status"))


def q_engine_not_yet_done(s, d):
    """Chunks that a run over some files leaves open: the chunk plan without the ledger."""
    c, loaded = begun(s, d), manifest.parse(SOURCE)
    todo = search.select_files(c.read("subtitle_files").join(search.pending(c, 1).select("file_id"), "file_id", "left_semi"), c.read("titles"), loaded.manifest.select)
    e = engine(s, d, c)
    return search.chunk_plan(e.sentences(e.placed(todo)), loaded.manifest).select("rel_path", "chunk_index", "kept", F.coalesce(F.length("prompt"), F.lit(-1)).cast("long").alias("n"))


def q_runs(s, d):
    """Runs by create, set_status, list_all and find_by_hash; a run that goes takes its queue along."""
    c = filled(s, d)
    e = engine(s, d, c)
    for i, status in enumerate(("paused", "done", "failed", "done"), 1):
        loaded = manifest.parse(SOURCE + "#" * (i % 2), f"m{i}.yaml")
        run = e._create(loaded)
        search.set_status(c, run, status)
        search.enqueue(c, run, loaded.manifest.select)
    c.delete("runs", s.createDataFrame([(4,)], "run_id long"), ["run_id"])
    same = search.find_by_hash(c, manifest.source_hash(SOURCE), unfinished=False).select("run_id", F.lit(True).alias("same"))
    queue = c.read("run_files").groupBy("run_id").agg(F.count("*").alias("queued"))
    return search.list_runs(c).join(same, "run_id", "left").join(queue, "run_id").select("run_id", "status", "manifest_path", "manifest_hash", F.col("finished_at").isNotNull().alias("finished"), F.coalesce("same", F.lit(False)).alias("same"), "queued")


def q_run_states(s, d):
    c = filled(s, d)
    e = engine(s, d, c)
    for status in RUN_STATUSES:
        search.set_status(c, e._create(manifest.parse(SOURCE)), status)
    return tables.progress(c.read("runs"), RUN_STATUSES, name="runs")


def q_files_index(s, d):
    """Indexed twice, the second time without hashing: hashes and ids stay."""
    c = filled(s, d)
    ids = c.read("subtitle_files").select("file_id", F.lit(True).alias("same_id"))
    search.index_files(c, members(s, d), RELEASE)
    return c.read("subtitle_files").join(ids, "file_id", "left").select("rel_path", "release", "language", "imdb_id", "subtitle_id", "year", "sha256", "size_bytes", "same_id")


def q_files_by_path(s, d):
    c = filled(s, d)
    first = c.read("subtitle_files").orderBy("rel_path").head()
    got = search.get_by_path(c, RELEASE, first.language, first.rel_path)
    none = search.get_by_path(c, RELEASE, first.language, "no such path")
    return s.createDataFrame([(got.rel_path, got.sha256, got.size_bytes, none is None)], "rel_path string, sha256 string, size_bytes long, unknown_is_none boolean")


def q_files_stale(s, d):
    c = filled(s, d)
    k = F.col("subtitle_id").cast("long")
    c.rewrite("subtitle_files", lambda f: f.withColumn("sha256", F.when(k % 10 != 0, F.col("sha256"))))
    now_ = c.read("subtitle_files").select("file_id", F.when(k % 7 == 0, F.lit("other")).otherwise(F.col("sha256")).alias("sha256"), k.alias("k")).where("k % 11 <> 0")
    return search.stale(c.read("subtitle_files"), now_).select("rel_path", "sha256")


def q_files_set_hash(s, d):
    c = tables.Catalog(s, scratch(s))
    c.initialize()
    search.index_files(c, members(s, d), RELEASE)
    first = c.read("subtitle_files").orderBy("rel_path").head()
    search.set_hash(c, first.file_id, "fixed")
    return c.read("subtitle_files").select("rel_path", "sha256")


def q_catalog_status(s, d):
    """Counts of the tables after files went, with what refers to them, and after a vacuum."""
    c = copied(searched(s, d))
    gone = c.read("subtitle_files").where(F.col("subtitle_id").cast("long") % 7 == 0).select("file_id")
    c.delete("subtitle_files", gone, ["file_id"])
    c.vacuum(analyze=False, older_than=0)
    c.initialize()
    got = c.status()
    return s.createDataFrame([tuple(got[k] for k in ("schema_version", "titles", "subtitle_files", "runs", "run_files", "ledger"))], "schema_version long, titles long, subtitle_files long, runs long, run_files long, ledger long")


def q_downloads(s, d):
    """A download per source and language: merged twice, marked, looked up, listed."""
    c = tables.Catalog(s, scratch(s))
    c.initialize()
    own = _t(s, d, "documents").where("source is not null and lang is not null").groupBy("source", "lang").agg(F.min("doc_id").alias("download_id"))
    none = F.lit(None).cast("string")
    rows = own.select("download_id", F.col("source").alias("corpus"), F.lit(RELEASE).alias("release"), F.col("lang").alias("language"), F.lit("pending").alias("status"), F.concat(F.lit("http://x/"), "source").alias("url"), none.alias("archive_path"), none.alias("sha256"))
    keep = ("url", "archive_path", "sha256", "download_id")
    c.upsert("downloads", rows, keep)
    low = c.read("downloads").agg(F.min("download_id")).first()[0]
    tables.mark_download(c, low, "downloaded", "h", "/p", verified=True)
    tables.mark_download(c, -1, "failed")
    c.upsert("downloads", rows.withColumn("url", none).where(F.col("download_id") != low), keep)
    found = c.get("downloads", download_id=low)
    return tables.ordered_downloads(c).select("corpus", "language", "status", "url", "sha256", "archive_path", F.col("downloaded_at").isNotNull().alias("downloaded"), F.col("verified_at").isNotNull().alias("verified"), F.lit(found.sha256).alias("got"))


def _imported(s: SparkSession, d: str) -> tables.Catalog:
    """Title lists in their public form, written from the titles and read in."""
    c = tables.Catalog(s, scratch(s))
    c.initialize()
    t = titles(s, d)
    text_of = lambda x: F.coalesce(x.cast("string"), F.lit("\\N"))
    nothing = F.lit(None)
    columns = {
        titles_tsv.BASICS: (t, ("imdb_id", "title_type", "primary_title", "original_title", F.col("is_adult").cast("int"), "start_year", nothing, nothing, nothing)),
        titles_tsv.EPISODES: (t.where("parent_imdb_id is not null"), ("imdb_id", "parent_imdb_id", "season_number", "episode_number")),
    }
    for (name, head), (rows, own) in columns.items():
        line = F.concat_ws("\t", *[text_of(F.col(x) if isinstance(x, str) else x) for x in own])
        path = f"{c.root}/_lists/{name[:-3]}"
        header = s.range(1).select(F.lit(0).alias("k"), F.lit("\t".join(head)).alias("value"))
        rows.select(F.lit(1).alias("k"), line.alias("value")).union(header).repartition(1).sortWithinPartitions("k").select("value").write.option("compression", "gzip").text(path)
    titles_tsv.import_basics(c, f"{c.root}/_lists/{titles_tsv.BASICS[0][:-3]}")
    titles_tsv.import_episodes(c, f"{c.root}/_lists/{titles_tsv.EPISODES[0][:-3]}")
    return c


def q_titles_import(s, d):
    c = _imported(s, d)
    return c.read("titles").select("imdb_id", "title_type", "primary_title", "original_title", "start_year", "is_adult", "parent_imdb_id", *[F.coalesce(x, F.lit(-1)).alias(x) for x in ("season_number", "episode_number")], F.lit(c.count("imports")).alias("imports"))


def q_titles_resolve_many(s, d):
    c = filled(s, d)
    ids = _t(s, d, "benchmark").select(text.title_id(F.col("item_id").cast("string")).alias("imdb_id"))
    return titles_tsv.resolve_many(c.read("titles"), ids).select("imdb_id", "primary_title", "parent_title")


def q_titles_resolve(s, d):
    """One title with its parent, by id; none for an unknown one."""
    c = filled(s, d)
    last = c.read("titles").where("parent_imdb_id is not null").agg(F.max("imdb_id")).first()[0]
    got, row = titles_tsv.resolve(c.read("titles"), last), c.get("titles", imdb_id=last)
    none = titles_tsv.resolve(c.read("titles"), "tt9999999999") is None and c.get("titles", imdb_id="tt9999999999") is None
    return s.createDataFrame([(got.imdb_id, got.primary_title, got.parent_title, row.primary_title, none)], "imdb_id string, primary_title string, parent_title string, plain_title string, unknown_is_none boolean")


def xml_files(s: SparkSession, d: str) -> DataFrame:
    """The files as subtitle documents: a sentence per line, a start marker in every other one, its end marker in the next."""
    esc = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    mark = lambda i, side: F.concat(F.lit('<time id="T'), i.cast("string"), F.lit(f'{side}" value="'), i.cast("string"), F.lit('"/>'))
    line = lambda x, i: F.concat(F.lit('\n<s id="'), (i + 1).cast("string"), F.lit('">'), F.when(i % 2 == 0, mark(i, "S")).otherwise(""), esc(x), F.when(i % 2 == 1, mark(i, "E")).otherwise(""), F.when(i % 3 > 0, F.lit("</s>")).otherwise(""))
    body = F.concat(F.lit('<?xml version="1.0"?><!-- no <s> here --><document id="1">'), F.array_join(F.transform(text.text_sentences(F.col("text")), line), ""), F.lit("</document>"))
    return files(s, d).withColumn("content", body)


def q_xml_sentences(s, d):
    return text.exploded(text.with_sentences(xml_files(s, d).select("file_id", "content"))).select("file_id", F.col("s.idx").alias("sentence_index"), F.col("s.id").alias("id"), F.col("s.text").alias("text"), F.col("s.start").alias("start_mark"), F.col("s.end").alias("end_mark"))


def q_xml_chunks(s, d):
    c = text.chunked(text.with_sentences(xml_files(s, d).select("file_id", "content")).drop("content"), 8, 2)
    return c.select("file_id", "chunk_index", "first_sentence_index", "last_sentence_index", "last_chunk", F.col("sents")[0]["start"].alias("first_mark"), F.sha2(text.rendered(F.col("sents")), 256).alias("sha"))


def _archive(s: SparkSession, d: str) -> str:
    """A zip of the labels' files, written by the tasks that have them."""
    key = (s.sparkContext.applicationId, d, "archive")
    if key not in _made or not Path(_made[key]).exists():
        path = local_folder(s) / "corpus.zip"
        rows = xml_files(s, d).join(_t(s, d, "labels").select(F.col("doc_id").alias("file_id")).distinct(), "file_id", "left_semi").select("rel_path", "content")
        zip_corpus.written(rows, str(path), ("corpus/raw/", "corpus/README", "corpus/raw/LICENSE", "corpus/raw/en/x.xml.gz", "corpus/raw/en/1999/a/b/c.xml"))
        _made[key] = str(path)
    return _made[key]


def q_zip_entries(s, d):
    path = _archive(s, d)
    got = zip_corpus.entries(s, path, content=True)
    return got.select("rel_path", "language", "year", "imdb_id", "subtitle_id", F.sha2("content", 256).alias("sha256"), F.lit(zip_corpus.rejected(s, path)).cast("long").alias("rejected"))


def q_zip_contents(s, d):
    """Texts read from the archive by name, for the files of one language, and a name that it lacks."""
    path = _archive(s, d)
    want = files(s, d).where("language = 'en'").select("file_id", "rel_path")
    got = text.with_sentences(zip_corpus.contents(want, path))
    return got.select("file_id", F.coalesce(F.size("sentences"), F.lit(-1)).cast("long").alias("n"), F.col("content").isNull().alias("missing"))


def q_zip_member(s, d):
    path = _archive(s, d)
    first = zip_corpus.entries(s, path).agg(F.min("rel_path")).first()[0]
    return s.createDataFrame([(first, zip_corpus.open_member(s, path, first).decode())], "rel_path string, content string").select("rel_path", F.sha2("content", 256).alias("sha256"))


def q_zip_summary(s, d):
    return zip_corpus.summary(zip_corpus.members(s, _archive(s, d), every=True), 3, order="rel_path").select(*[f"{k}_count" for k in ("subtitle", "metadata", "unexpected")], *[F.array_join(f"{k}_sample", ",").alias(f"{k}_sample") for k in ("subtitle", "metadata", "unexpected")])


class Reply:
    def __init__(self, status: int, body: bytes) -> None:
        self.status, self.body, self.headers = status, body, {"Content-Length": str(len(body))}

    def blocks(self) -> Iterator[bytes]:
        yield self.body


def _index(s: SparkSession, d: str) -> DataFrame:
    """A release index as the service gives it, with a record per nation: fixed in size at any scale."""
    rows = _t(s, d, "nation").orderBy("n_nationkey").collect()
    records = [{"corpus": "C", "version": f"v{(r.n_nationkey * 7) % 11}", "preprocessing": "raw", "source": f"l{r.n_regionkey}", "target": "" if r.n_nationkey % 4 else "xx", "url": f"http://x/{r.n_name}", "size": r.n_nationkey, "documents": 1} for r in rows]
    return releases.records(s, lambda u, h: Reply(200, json.dumps({"corpora": records}).encode()), "C")


def q_release_records(s, d):
    return _index(s, d)


def q_release_versions(s, d):
    return text.numbered(releases.available_versions(_index(s, d), "l1"), [F.desc(text.version_key(F.col("version"))), F.desc("version")])


def q_release_resolve(s, d):
    i = _index(s, d)
    r = releases.resolve(i, "l1")
    return s.createDataFrame([(r.version, r.url, releases.archive_name(r), releases.describe(i))], "version string, url string, archive string, description string")


def q_release_download(s, d):
    """A transfer that finds a part of itself, one that finds itself whole, and a forced one: sizes and digests."""
    r = releases.resolve(_index(s, d), "l1")
    folder, body = local_folder(s), b"".join(b"%d " % i for i in range(20000))
    (folder / f"{releases.archive_name(r)}.part").write_bytes(body[:512])

    def fetch(url: str, headers: dict[str, str]) -> Reply:
        at = int(headers["Range"][6:-1]) if "Range" in headers else 0
        return Reply(206 if at else 200, body[at:])

    got = [releases.download(r, folder, fetch, force) for force in (False, False, True)]
    rows = [(i, x.path.stat().st_size, releases.sha256_file(x.path), x.sha256 is not None, x.skipped) for i, x in enumerate(got)]
    return s.createDataFrame(rows, "step int, size long, sha256 string, hashed boolean, skipped boolean")


def q_manifest(s, d):
    loaded = [manifest.parse(x) for x in (SOURCE, SOURCE.replace("\n", "\r\n"), SOURCE + "#\n")]
    return s.createDataFrame([(i, x.hash, x.manifest.name, x.manifest.chunk.size, x.manifest.chunk.overlap, ",".join(x.manifest.select.languages), x.manifest.prefilter.enabled) for i, x in enumerate(loaded)], "i int, hash string, name string, size int, overlap int, languages string, prefilter boolean")


def q_stream_files(s, d):
    """Files that arrive twice, drained twice: each is queued once."""
    c = filled(s, d)
    rows = c.read("subtitle_files").select(F.lit(1).cast("long").alias("run_id"), "file_id", F.lit(tables.now()).alias("queued_at"), "sha256")
    folder = f"{c.root}/_arrivals"
    for _ in range(2):
        rows.write.mode("append").parquet(folder)
        drain(arrivals(s, folder, TABLES["run_files"], ["run_id", "file_id"]), c, "run_files", f"{c.root}/_progress")
    return by_path(c, c.read("run_files"), "sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

#: Chunks of the selected files with what the search says of them; and the files of a limit by path.
SQL_W = "w AS (SELECT c.*, contains(lower(txt),'license') OR contains(lower(txt),'ation') AS kept, contains(lower(txt),'license') AS m, 10 + length(c.imdb_id) - 9 + length(ids) AS n FROM (SELECT file_id, rel_path, language, imdb_id, k AS chunk_index, k*6 AS first_sentence_index, least(k*6+8, n)-1 AS last_sentence_index, k*6+8 >= n AS last_chunk, array_to_string(a[k*6+1 : k*6+8], chr(10)) AS txt, array_to_string(list_transform(range(k*6+1, least(k*6+8,n)+1), lambda i: concat('[', i, '] ', a[i])), chr(10)) AS ids FROM (SELECT *, len(a) AS n, unnest(range(0, 1 + CAST(ceil(greatest(len(a)-8, 0)/6) AS BIGINT))) AS k FROM s WHERE len(a) > 0)) c JOIN titles USING (imdb_id) WHERE language IN ('en','fr') AND NOT is_adult)"
SQL_Q = "q AS (SELECT rel_path, len(a) AS n, file_id, imdb_id FROM s JOIN titles USING (imdb_id) WHERE language IN ('en','fr') AND NOT is_adult)"
ANSWERS = "SELECT rel_path, chunk_index, CASE WHEN kept THEN 'result' ELSE 'skipped' END AS kind, first_sentence_index, last_sentence_index, CAST(first_sentence_index + 1 AS VARCHAR) AS first_sentence_id, CAST(last_sentence_index + 1 AS VARCHAR) AS last_sentence_id, last_chunk, kept AND m AS matched, CASE WHEN kept THEN n ELSE -1 END AS n FROM w"
FAILED = "f AS (SELECT rel_path, count(*) FILTER (NOT (kept AND n % 5 = 0)) AS chunks_done, max(last_sentence_index) FILTER (NOT (kept AND n % 5 = 0)) AS last_sentence_index, count(*) FILTER (kept AND n % 5 = 0) AS failed FROM w GROUP BY rel_path), st AS (SELECT q.rel_path, CASE WHEN coalesce(failed, 0) = 0 THEN 'done' ELSE 'error' END AS status, coalesce(chunks_done, 0) AS chunks_done, coalesce(f.last_sentence_index, -1) AS last_sentence_index, CASE WHEN failed > 0 THEN 'no answer' END AS error FROM q LEFT JOIN f USING (rel_path))"
RELEASES = "i AS (SELECT n_nationkey AS ordinal, 'C' AS corpus, concat('v', (n_nationkey * 7) % 11) AS version, 'raw' AS preprocessing, concat('l', n_regionkey) AS source, CASE WHEN n_nationkey % 4 = 0 THEN 'xx' ELSE '' END AS target, concat('http://x/', n_name) AS url, n_nationkey AS size FROM nation)"
ZIP = "z AS (SELECT * FROM x WHERE file_id IN (SELECT doc_id FROM labels))"
XML = "x AS (SELECT file_id, rel_path, language, imdb_id, a, concat('<?xml version=\"1.0\"?><!-- no <s> here --><document id=\"1\">', array_to_string(list_transform(range(0, len(a)), lambda i: concat(chr(10), '<s id=\"', i + 1, '\">', CASE WHEN i % 2 = 0 THEN concat('<time id=\"T', i, 'S\" value=\"', i, '\"/>') ELSE '' END, replace(replace(replace(a[i + 1], '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), CASE WHEN i % 2 = 1 THEN concat('<time id=\"T', i, 'E\" value=\"', i, '\"/>') ELSE '' END, CASE WHEN i % 3 > 0 THEN '</s>' ELSE '' END)), ''), '</document>') AS content FROM s)"

SQL = r"""
engine_start: WITH {F}, {T}, {S}, {W} {ANSWERS}
engine_failures: WITH {F}, {T}, {S}, {W} SELECT rel_path, chunk_index, 'no answer' AS error FROM w WHERE kept AND n % 5 = 0
engine_resume: WITH {F}, {T}, {S}, {W} {ANSWERS}
engine_file_status: WITH {F}, {T}, {S}, {W}, {Q}, {FAILED} SELECT * FROM st
engine_progress: WITH {F}, {T}, {S}, {W}, {Q}, {FAILED} SELECT v.status, count(st.rel_path) AS files FROM (VALUES ('pending'),('in_progress'),('done'),('skipped'),('error')) v(status) LEFT JOIN st USING (status) GROUP BY v.status
engine_outcome: WITH {F}, {T}, {S}, {W}, {Q} SELECT (SELECT count(*) FROM q) AS files_done, count(*) AS chunks_done, count(*) FILTER (NOT kept) AS chunks_skipped, count(*) FILTER (kept AND m) AS matches, (SELECT count(*) FROM q) AS plan_done, (SELECT count(*) FROM q) AS plan_files, count(*) FILTER (kept) AS results, count(*) FILTER (kept AND m) AS matched_results, 'done' AS status FROM w
engine_export: WITH {F}, {T}, {S}, {W} SELECT w.imdb_id, concat(CASE WHEN c.parent_imdb_id IS NOT NULL THEN concat(CASE WHEN p.primary_title IS NOT NULL THEN p.primary_title || ' ' ELSE '' END, printf('S%02dE%02d', c.season_number, c.episode_number), ' — ') ELSE '' END, c.primary_title, ' (', c.start_year, ')') AS title, c.start_year AS year, rel_path, chunk_index, first_sentence_index, last_sentence_index, CAST(first_sentence_index + 1 AS VARCHAR) AS first_sentence_id, CAST(last_sentence_index + 1 AS VARCHAR) AS last_sentence_id, true AS matched, 'stand-in' AS model, n, count(*) OVER () AS lines FROM w JOIN titles c ON w.imdb_id = c.imdb_id LEFT JOIN titles p ON c.parent_imdb_id = p.imdb_id WHERE kept AND m
engine_enqueue: WITH {F}, {T}, {S}, {Q} SELECT rel_path, count(*) OVER () AS added, (SELECT count(*) FROM files WHERE language IN ('en','fr') AND imdb_id NOT IN (SELECT imdb_id FROM titles)) AS unresolved, 0 AS again FROM q
engine_work: WITH {F}, {T}, {S}, {Q} SELECT rel_path, 'pending' AS status FROM q ORDER BY rel_path LIMIT 25 OFFSET 20
engine_refresh: WITH {F}, {T}, {S}, {Q} SELECT rel_path, CASE WHEN file_id % 7 = 0 THEN 'pending' ELSE 'done' END AS status, CASE WHEN (SELECT count(*) FROM q WHERE file_id % 7 = 0) > 0 THEN 'paused' ELSE 'done' END AS run_status FROM q
engine_not_yet_done: WITH {F}, {T}, {S}, {W}, {Q} SELECT rel_path, chunk_index, kept, CASE WHEN kept THEN n ELSE -1 END AS n FROM w WHERE rel_path NOT IN (SELECT rel_path FROM q ORDER BY rel_path LIMIT 20)
runs: WITH {F}, {T}, {S}, {Q} SELECT run_id, ['paused','done','failed'][run_id] AS status, concat('m', run_id, '.yaml') AS manifest_path, CASE WHEN run_id = 2 THEN '{HASH}' ELSE '{HASH1}' END AS manifest_hash, run_id = 2 AS finished, run_id = 2 AS same, (SELECT count(*) FROM q) AS queued FROM range(1, 4) r(run_id)
run_states: SELECT unnest(['pending','running','paused','done','failed']) AS status, 1 AS runs
files_index: WITH {F} SELECT rel_path, 'v1' AS release, language, imdb_id, CAST(file_id AS VARCHAR) AS subtitle_id, year, sha256(text) AS sha256, octet_length(encode(text)) AS size_bytes, true AS same_id FROM files
files_by_path: WITH {F} SELECT rel_path, sha256(text) AS sha256, octet_length(encode(text)) AS size_bytes, true AS unknown_is_none FROM files ORDER BY rel_path LIMIT 1
files_stale: WITH {F} SELECT rel_path, CASE WHEN file_id % 10 <> 0 THEN sha256(text) END AS sha256 FROM files WHERE file_id % 10 = 0 OR (file_id % 7 = 0 AND file_id % 11 <> 0)
files_set_hash: WITH {F} SELECT rel_path, CASE WHEN rel_path = (SELECT min(rel_path) FROM files) THEN 'fixed' END AS sha256 FROM files
catalog_status: WITH {F}, {T}, {S}, {W}, {Q} SELECT 2 AS schema_version, (SELECT count(*) FROM titles) AS titles, (SELECT count(*) FROM files WHERE file_id % 7 <> 0) AS subtitle_files, 1 AS runs, (SELECT count(*) FROM q WHERE file_id % 7 <> 0) AS run_files, (SELECT count(*) FROM w WHERE file_id % 7 <> 0) + (SELECT count(*) FROM q WHERE file_id % 7 <> 0 AND n = 0) AS ledger
downloads: WITH d AS (SELECT source, lang, min(doc_id) AS id FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL), m AS (SELECT min(id) AS low FROM d) SELECT source AS corpus, lang AS language, CASE WHEN id = low THEN 'downloaded' ELSE 'pending' END AS status, concat('http://x/', source) AS url, CASE WHEN id = low THEN 'h' END AS sha256, CASE WHEN id = low THEN '/p' END AS archive_path, id = low AS downloaded, id = low AS verified, 'h' AS got FROM d, m
titles_import: WITH {T} SELECT imdb_id, title_type, primary_title, CAST(NULL AS VARCHAR) AS original_title, start_year, is_adult, parent_imdb_id, coalesce(season_number, -1) AS season_number, coalesce(episode_number, -1) AS episode_number, 2 AS imports FROM titles
titles_resolve_many: WITH {T} SELECT c.imdb_id, c.primary_title, p.primary_title AS parent_title FROM titles c LEFT JOIN titles p ON c.parent_imdb_id = p.imdb_id WHERE c.imdb_id IN (SELECT printf('tt%07d', item_id) FROM benchmark)
titles_resolve: WITH {T} SELECT c.imdb_id, c.primary_title, p.primary_title AS parent_title, c.primary_title AS plain_title, true AS unknown_is_none FROM titles c LEFT JOIN titles p ON c.parent_imdb_id = p.imdb_id WHERE c.imdb_id = (SELECT max(imdb_id) FROM titles WHERE parent_imdb_id IS NOT NULL)
xml_sentences: WITH {F}, {S} SELECT file_id, i AS sentence_index, CAST(i + 1 AS VARCHAR) AS id, a[i + 1] AS text, CAST(i - i % 2 AS VARCHAR) AS start_mark, CASE WHEN i + 1 - i % 2 < n THEN CAST(i + 1 - i % 2 AS VARCHAR) END AS end_mark FROM (SELECT file_id, a, len(a) AS n, unnest(range(0, len(a))) AS i FROM s)
xml_chunks: WITH {F}, {S} SELECT file_id, k AS chunk_index, k*6 AS first_sentence_index, least(k*6+8, n)-1 AS last_sentence_index, k*6+8 >= n AS last_chunk, CAST(k*6 AS VARCHAR) AS first_mark, sha256(array_to_string(list_transform(range(k*6+1, least(k*6+8,n)+1), lambda i: concat('[', i, '] ', a[i])), chr(10))) AS sha FROM (SELECT file_id, a, len(a) AS n, unnest(range(0, 1 + CAST(ceil(greatest(len(a)-8, 0)/6) AS BIGINT))) AS k FROM s WHERE len(a) > 0)
zip_entries: WITH {F}, {S}, {XML}, {ZIP} SELECT rel_path, language, CAST(string_split(rel_path,'/')[4] AS INTEGER) AS year, imdb_id, CAST(file_id AS VARCHAR) AS subtitle_id, sha256(content) AS sha256, 1 AS rejected FROM z
zip_contents: WITH {F}, {S}, {XML}, {ZIP} SELECT x.file_id, coalesce(len(z.a), -1) AS n, z.file_id IS NULL AS missing FROM x LEFT JOIN z USING (file_id) WHERE x.language = 'en'
zip_member: WITH {F}, {S}, {XML}, {ZIP} SELECT rel_path, sha256(content) AS sha256 FROM z ORDER BY rel_path LIMIT 1
zip_summary: WITH {F}, {S}, {XML}, {ZIP} SELECT (SELECT count(*) FROM z) + 1 AS subtitle_count, 2 AS metadata_count, 1 AS unexpected_count, (SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT rel_path AS p FROM z UNION ALL SELECT 'corpus/raw/en/1999/a/b/c.xml' ORDER BY p LIMIT 3)) AS subtitle_sample, 'corpus/README,corpus/raw/LICENSE' AS metadata_sample, 'corpus/raw/en/x.xml.gz' AS unexpected_sample
release_records: WITH {RELEASES} SELECT * FROM i
release_versions: WITH {RELEASES} SELECT version, row_number() OVER (ORDER BY CAST(version[2:] AS BIGINT) DESC) AS rank FROM (SELECT DISTINCT version FROM i WHERE target = '' AND source = 'l1')
release_resolve: WITH {RELEASES} SELECT version, url, concat('C_', version, '_raw_l1.zip') AS archive, (SELECT concat('versions ', array_to_string(list_sort(list(DISTINCT version)), ', '), '; languages ', array_to_string(list_sort(list(DISTINCT source) FILTER (target = '')), ', ')) FROM i) AS description FROM i WHERE target = '' AND source = 'l1' ORDER BY ordinal LIMIT 1
release_download: WITH b AS (SELECT string_agg(concat(i, ' '), '' ORDER BY i) AS t FROM range(0, 20000) r(i)) SELECT step, length(t) AS size, sha256(t) AS sha256, step = 2 AS hashed, step = 1 AS skipped FROM b, range(0, 3) r(step)
manifest: SELECT i, CASE WHEN i < 2 THEN '{HASH}' ELSE '{HASH2}' END AS hash, 'flows' AS name, 8 AS size, 2 AS overlap, 'en,fr' AS languages, true AS prefilter FROM range(0, 3) r(i)
stream_files: WITH {F} SELECT rel_path, sha256(text) AS sha256 FROM files
"""


def oracles() -> dict[str, str]:
    from millrace.plans.catalogue import SQL_F, SQL_S, SQL_T

    parts = {"{F}": SQL_F, "{T}": SQL_T, "{S}": SQL_S, "{W}": SQL_W, "{Q}": SQL_Q, "{ANSWERS}": ANSWERS, "{FAILED}": FAILED, "{RELEASES}": RELEASES, "{XML}": XML, "{ZIP}": ZIP}
    parts |= {f"{{HASH{k}}}": manifest.source_hash(SOURCE + x) for k, x in (("", ""), ("1", "#"), ("2", "#\n"))}
    out = {}
    for line in SQL.strip().splitlines():
        name, sql = line.split(": ", 1)
        for mark, part in parts.items():
            sql = sql.replace(mark, part)
        out[name] = sql
    return out
