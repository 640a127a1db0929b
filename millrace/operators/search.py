"""The search: selection, queue, waves of model calls, the ledger, resuming, results and export.

The ledger has one row per chunk that was dealt with, and is only appended to; cursors, statuses and counts are
aggregates of it, so a cursor is never ahead of its results.  Failed calls go to a table of their own, so retries leave
one ledger row per chunk.  What is left to do is worked out once per run: files that aren't finished, each with the
chunks that it has.  Files are dealt to waves; a wave cuts its files, calls the model for the chunks that lack an answer,
and is written once, so no call is repeated by a count or a second action.  A chunk is called once in a run, whether it
fails or not, and again when the run is resumed.  A wave's tasks stop calling after wave_seconds and leave the rest to the
wave's next pass, so a stop request waits no longer, and an abort loses no more.  No sentence or prompt is stored.

A wave reads no more than its own files: what tells where their texts are, or the texts of a corpus that can't be read by
name, is found once for all of a run's files and lies with its waves until the run ends.
"""

from __future__ import annotations

import json
import logging
import threading
import time
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F

from millrace.errors import ModelError, SearchError
from millrace.functions import jsonout, text
from millrace.operators.tables import Catalog, changes, now, progress
from millrace.plans.manifest import Loaded, Manifest, Select, parse
from millrace.schema import FILE_STATUSES
from millrace.sources.titles_tsv import with_parents

log = logging.getLogger("millrace")


@dataclass(frozen=True)
class Completion:
    text: str
    model: str
    latency_ms: int


class Client(Protocol):
    def complete(self, *, model: str, user: str, system: str | None = None, options: dict[str, Any] | None = None, json_schema: dict[str, Any] | None = None) -> Completion: ...


class HttpClient:
    """A model server's chat endpoint, by HTTP: up to three tries."""

    def __init__(self, host: str = "http://localhost:11434", timeout: float = 300.0, retries: int = 3) -> None:
        self.host, self.timeout, self.retries = host.rstrip("/"), timeout, retries

    def _post(self, path: str, body: dict) -> dict:
        req = urllib.request.Request(self.host + path, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(req, timeout=self.timeout) as r:
            return json.loads(r.read())

    def complete(self, *, model: str, user: str, system: str | None = None, options: dict | None = None, json_schema: dict | None = None) -> Completion:
        messages = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": user}]
        body = {"model": model, "messages": messages, "stream": False, "options": options or {}} | ({"format": json_schema} if json_schema else {})
        last: Exception | None = None
        for k in range(self.retries):
            began = time.monotonic()
            try:
                got = self._post("/api/chat", body)
                return Completion(got["message"]["content"], model, int((time.monotonic() - began) * 1000))
            except (OSError, ValueError, KeyError) as e:
                last = e
                time.sleep(2**k * 0.1)
        raise ModelError(f"{self.host}: {last}")

    def ensure_model(self, model: str) -> None:
        try:
            self._post("/api/show", {"model": model})
        except (OSError, ValueError) as e:
            raise ModelError(f"the model {model!r} isn't there: {e}") from e


def select_files(files: DataFrame, titles: DataFrame, select: Select) -> DataFrame:
    """The files that a manifest selects, with their titles.  Predicates on each side stand below the join."""
    own = files.where(select.of_files())
    t = with_parents(titles).where(select.of_titles())
    t = t.select("imdb_id", *[c for c in t.columns if c not in files.columns])
    return own.join(t, "imdb_id", "inner" if select.needs_title else "left")


def unresolved(files: DataFrame, titles: DataFrame) -> DataFrame:
    return files.join(titles.select("imdb_id"), "imdb_id", "left_anti")


def chunk_plan(files: DataFrame, manifest: Manifest, outer: bool = False) -> DataFrame:
    """files with sentences: a row per chunk with kept (whether the prefilter passes it) and its prompt if kept."""
    d = text.chunked(files, manifest.chunk.size, manifest.chunk.overlap, outer=outer)
    d = d.withColumn("kept", manifest.prefilter.keeps(text.rendered(F.col("sents"), with_ids=False)))
    label = F.coalesce(F.nullif(text.display_name(), F.lit("")), F.col("imdb_id"))
    values = {"title": label, "imdb_id": F.col("imdb_id"), "year": F.col("start_year"), "season": F.col("season_number"), "episode": F.col("episode_number"), "chunk": text.rendered(F.col("sents"))}
    return d.withColumn("prompt", F.when(F.col("kept"), text.prompt(manifest.prompt.user, values)))


@dataclass(frozen=True)
class Outcome:
    run_id: int
    files_done: int
    chunks_done: int
    chunks_skipped: int
    matches: int
    interrupted: bool


@dataclass(frozen=True)
class Queued:
    """Files that came into the queue, and files that the selection left out since their title is unknown."""

    files: int
    unresolved: int


class Engine:
    """sentences(files) gives the files of a wave their sentences column, null where a file's text is missing, and reads nothing
    that is larger than they are; placed(files) gives all files of a run, at once, the columns that sentences needs for that;
    client() makes one client per task; wave: files that are worked on together; concurrency: calls at a time."""

    def __init__(self, catalog: Catalog, client: Callable[[], Client], sentences: Callable[[DataFrame], DataFrame], concurrency: int = 4, wave: int = 2000, wave_seconds: float = 60.0, ensure_model: Callable[[str], None] | None = None, placed: Callable[[DataFrame], DataFrame] | None = None) -> None:
        if not 1 <= concurrency <= 64:
            raise SearchError("the concurrency must be 1 to 64")
        if wave < 1 or wave_seconds <= 0:
            raise SearchError("a wave needs a file and some time")
        self.catalog, self.client, self.sentences, self.concurrency, self.wave, self.wave_seconds = catalog, client, sentences, concurrency, wave, wave_seconds
        self.ensure_model, self.placed = ensure_model or (lambda model: None), placed or (lambda files: files)
        self._stop = threading.Event()

    def request_stop(self) -> None:
        """Stop after the pass that is under way; its answers are kept."""
        self._stop.set()

    def start(self, loaded: Loaded, limit: int | None = None) -> Outcome:
        self.catalog.ensure_current()
        self.ensure_model(loaded.manifest.model)
        found = find_by_hash(self.catalog, loaded.hash, unfinished=True).head()
        run_id = found.run_id if found else self._create(loaded)
        if not found:
            queued = enqueue(self.catalog, run_id, loaded.manifest.select)
            if queued.unresolved:
                log.warning("%d files are left out: their titles are unknown", queued.unresolved)
            if queued.files == 0:
                self._status(run_id, "failed")
                raise SearchError("the manifest selects no file")
        return self._run(run_id, loaded.manifest, limit)

    def resume(self, run_id: int, limit: int | None = None) -> Outcome:
        """From the manifest as it was when the run began."""
        self.catalog.ensure_current()
        row = self.catalog.get("runs", run_id=run_id)
        if row is None:
            raise SearchError(f"no run {run_id}")
        if row.status == "done":
            raise SearchError(f"run {run_id} is done")
        manifest = parse(row.manifest_snapshot, row.manifest_path).manifest
        self.ensure_model(manifest.model)
        return self._run(run_id, manifest, limit)

    def _create(self, loaded: Loaded) -> int:
        top = self.catalog.read("runs").agg(F.max("run_id")).first()[0] or 0
        data = [(top + 1, loaded.path, loaded.hash, loaded.source, loaded.manifest.model, "pending", now(), now())]
        self.catalog.append("runs", self.catalog.spark.createDataFrame(data, "run_id long, manifest_path string, manifest_hash string, manifest_snapshot string, model string, status string, created_at timestamp, updated_at timestamp").withColumn("finished_at", F.lit(None).cast("timestamp")))
        return top + 1

    def _status(self, run_id: int, status: str) -> None:
        set_status(self.catalog, run_id, status)

    def _run(self, run_id: int, manifest: Manifest, limit: int | None) -> Outcome:
        self._status(run_id, "running")
        session = uuid.uuid4().hex
        path = f"{self.catalog.root}/_work-{run_id}-{session}"
        try:
            waves = self._work(run_id, manifest, limit, path)
            work = self.catalog.spark.read.parquet(path)
            for k in range(waves):
                passes: list[dict] = []
                while not self._stop.is_set() and self._pass(run_id, session, manifest, work.where(F.col("wave") == k), passes):
                    pass
        finally:
            self.catalog._drop(path.rsplit("/", 1)[1], time.time() * 1000 + 1e6)
            interrupted = self._stop.is_set()
            self._stop.clear()
            left = pending(self.catalog, run_id).count()
            self._status(run_id, "paused" if interrupted or left else "done")
        return summary(self.catalog, run_id, interrupted)

    def _work(self, run_id: int, manifest: Manifest, limit: int | None, path: str) -> int:
        """The unfinished files with their titles, the chunks that they have, and their waves, written once; the number of waves."""
        todo = iter_work(self.catalog, run_id, limit).select("file_id")
        waves = max(1, -(-todo.count() // self.wave))
        files = self.catalog.read("subtitle_files").join(todo, "file_id", "left_semi")
        anyhow = manifest.select.model_copy(update={"exclude_adult": False, "title_types": (), "years": type(manifest.select.years)()})
        have = self.catalog.read("ledger").where(F.col("run_id") == run_id).groupBy("file_id").agg(F.collect_set("chunk_index").alias("have"))  # of one file
        titled = select_files(files, self.catalog.read("titles"), anyhow).join(have, "file_id", "left")
        deal = F.xxhash64("file_id")
        dealt = self.placed(titled).withColumn("wave", F.pmod(deal, F.lit(waves)).cast("int"))
        # as many files a wave as calls at a time, so that its chunks are cut by as many tasks
        dealt.repartition("wave", F.pmod(F.xxhash64(deal), F.lit(self.concurrency))).write.partitionBy("wave").parquet(path)
        return waves

    def _pass(self, run_id: int, session: str, manifest: Manifest, files: DataFrame, passes: list[dict]) -> bool:
        """Calls for the wave's open chunks, as many as its time allows; whether some are left."""
        make, model, system, options, schema = self.client, manifest.model, manifest.prompt.system, dict(manifest.options), manifest.output.json_schema
        most = self.wave_seconds

        def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client, until = make(), time.monotonic() + most
            for f in frames:
                rows = []
                for kept, p in zip(f["kept"], f["prompt"], strict=True):
                    if not kept:
                        rows.append((None, None, None, False))
                        continue
                    if time.monotonic() > until:
                        rows.append((None, None, None, True))
                        continue
                    try:
                        c = client.complete(model=model, user=p, system=system, options=options, json_schema=schema)
                        rows.append((c.text, c.latency_ms, None, False))
                    except Exception as e:  # noqa: BLE001  one chunk's error is recorded, the others go on
                        rows.append((None, None, str(e) or type(e).__name__, False))
                out = f.drop(columns=["prompt"])
                out[["raw", "latency_ms", "failure", "left"]] = pd.DataFrame(rows, index=f.index, columns=["raw", "latency_ms", "failure", "left"])
                out["latency_ms"], out["left"] = out["latency_ms"].astype("Int64"), out["left"].astype(bool)
                yield out

        plan = chunk_plan(self.sentences(files), manifest, outer=True)
        keys = ["file_id", "chunk_index"]
        plan = plan.withColumn("chunk_index", F.coalesce("chunk_index", F.lit(-1).cast("long"))).where(~F.array_contains(F.coalesce("have", F.expr("cast(array() as array<bigint>)")), F.col("chunk_index")))
        if passes:
            plan = plan.join(self.catalog.frame_of("ledger", passes).select(*keys), keys, "left_anti")
        first = F.coalesce("first_sentence_index", F.lit(-1)).alias("first_sentence_index"), F.coalesce("last_sentence_index", F.lit(-1)).alias("last_sentence_index")
        todo = plan.select(*keys, F.col("sents")[0]["id"].alias("first_sentence_id"), F.try_element_at("sents", F.lit(-1))["id"].alias("last_sentence_id"), *first, F.coalesce("last_chunk", F.lit(True)).alias("last_chunk"), "no_text", F.coalesce("kept", F.lit(False)).alias("kept"), "prompt")
        kind = "file_id long, chunk_index long, first_sentence_id string, last_sentence_id string, first_sentence_index long, last_sentence_index long, last_chunk boolean, no_text boolean, kept boolean, raw string, latency_ms long, failure string, left boolean"
        answered = todo.repartition(self.concurrency, *keys).mapInPandas(call, kind)
        v = jsonout.validated(F.col("raw"), manifest.output.format, schema, manifest.match_when)
        error = F.when(F.col("no_text"), F.lit("the file's text is missing")).when(F.col("kept"), F.coalesce("failure", F.col("v.error")))
        good = F.col("kept") & error.isNull()
        rows = answered.withColumn("v", v).select(
            F.when(F.col("left"), "left").when(error.isNotNull(), "failures").otherwise("ledger").alias("outcome"),
            F.lit(run_id).cast("long").alias("run_id"), *keys, F.lit(session).alias("session"),
            F.when(F.col("chunk_index") < 0, "empty").when(~F.col("kept"), "skipped").otherwise("result").alias("kind"),
            "first_sentence_index", "last_sentence_index", "last_chunk", F.coalesce(good & F.col("v.matched"), F.lit(False)).alias("matched"),
            F.lit(model).alias("model"), F.lit(now()).alias("created_at"), "first_sentence_id", "last_sentence_id",
            F.when(good, F.col("v.payload")).alias("payload"), "latency_ms", error.alias("error"),
        )
        parts = self.catalog.store_wave(rows, "outcome")
        for table in ("ledger", "failures"):
            if table in parts:
                self.catalog.append_part(table, parts[table])
                passes.append(parts[table])
        return "left" in parts


def set_status(catalog: Catalog, run_id: int, status: str) -> None:
    own, stamp = F.col("run_id") == run_id, F.lit(now())
    fresh = {"status": F.lit(status), "updated_at": stamp} | ({"finished_at": stamp} if status == "done" else {})
    catalog.rewrite("runs", lambda r: r.withColumns({c: F.when(own, v).otherwise(F.col(c)) for c, v in fresh.items()}))


def list_runs(catalog: Catalog) -> DataFrame:
    return catalog.read("runs").orderBy(F.desc("run_id"))


def find_by_hash(catalog: Catalog, manifest_hash: str, unfinished: bool = False) -> DataFrame:
    """Runs of a manifest, the newest first."""
    d = list_runs(catalog).where(F.col("manifest_hash") == manifest_hash)
    return d.where(F.col("status") != "done") if unfinished else d


def enqueue(catalog: Catalog, run_id: int, select: Select) -> Queued:
    """The selection into the run's queue; files that are there stay as they are."""
    files, titles = catalog.read("subtitle_files"), catalog.read("titles")
    chosen = select_files(files, titles, select)
    rows = chosen.select(F.lit(run_id).cast("long").alias("run_id"), "file_id", F.lit(now()).alias("queued_at"), "sha256")
    lacking = unresolved(files.where(select.of_files()), titles).count() if select.needs_title else 0
    return Queued(catalog.insert_missing("run_files", rows), lacking)


def cursors(ledger: DataFrame) -> DataFrame:
    """(run_id, file_id, chunks_done, last_sentence_index, last_sentence_id, finished): the ledger, aggregated.  A file without
    chunks has one row of index -1."""
    real = F.col("chunk_index") >= 0
    return ledger.groupBy("run_id", "file_id").agg(
        F.count_distinct(F.when(real, F.col("chunk_index"))).alias("chunks_done"), F.max("last_sentence_index").alias("last_sentence_index"), F.max_by("last_sentence_id", "chunk_index").alias("last_sentence_id"),
        F.max(F.when(F.col("last_chunk"), F.col("chunk_index") + 1)).alias("_end"),
    ).withColumn("finished", F.coalesce(F.col("_end") == F.col("chunks_done"), F.lit(False))).drop("_end")


def resume_position(chunks_done: int, size: int, overlap: int) -> tuple[int, int]:
    """(first sentence, first chunk) to go on from."""
    text.check_window(size, overlap)
    return chunks_done * (size - overlap), chunks_done


def run_files(catalog: Catalog, run_id: int) -> DataFrame:
    """The queue with statuses and cursors.  error: the last failure among the chunks that still lack an answer."""
    own = F.col("run_id") == run_id
    ledger = catalog.read("ledger").where(own)
    open_ = catalog.read("failures").where(own).join(ledger, ["run_id", "file_id", "chunk_index"], "left_anti")
    failed = open_.groupBy("run_id", "file_id").agg(F.max_by("error", "created_at").alias("error"))
    d = catalog.read("run_files").where(own).join(cursors(ledger), ["run_id", "file_id"], "left").join(failed, ["run_id", "file_id"], "left")
    status = F.when(F.col("finished"), "done").when(F.col("error").isNotNull(), "error").when(F.col("chunks_done") > 0, "in_progress").otherwise("pending")
    return d.withColumn("status", status)


def pending(catalog: Catalog, run_id: int) -> DataFrame:
    return run_files(catalog, run_id).where(~F.col("status").isin("done", "skipped"))


def iter_work(catalog: Catalog, run_id: int, limit: int | None = None) -> DataFrame:
    """Unfinished files by path."""
    paths = catalog.read("subtitle_files").select("file_id", "rel_path", "imdb_id")
    d = pending(catalog, run_id).join(paths, "file_id").orderBy("rel_path")
    return d if limit is None else d.limit(limit)


def plan_size(catalog: Catalog, run_id: int) -> tuple[int, int]:
    r = run_files(catalog, run_id).agg(F.count_if(F.col("status") == "done"), F.count("*")).first()
    return r[0], r[1]


def run_progress(catalog: Catalog, run_id: int) -> DataFrame:
    return progress(run_files(catalog, run_id), FILE_STATUSES)


def counters(ledger: DataFrame) -> DataFrame:
    real = F.col("kind") != "empty"
    return ledger.agg(F.count_distinct("file_id").alias("files_done"), F.count_if(real).alias("chunks_done"), F.count_if(F.col("kind") == "skipped").alias("chunks_skipped"), F.count_if(F.col("matched")).alias("matches"))


def results(catalog: Catalog, run_id: int, matched_only: bool = False) -> DataFrame:
    """The answers of a run by file and chunk."""
    d = catalog.read("ledger").where((F.col("run_id") == run_id) & (F.col("kind") == "result"))
    return (d.where("matched") if matched_only else d).orderBy("file_id", "chunk_index")


def summary(catalog: Catalog, run_id: int, interrupted: bool = False) -> Outcome:
    r = counters(catalog.read("ledger").where(F.col("run_id") == run_id)).first()
    done, _ = plan_size(catalog, run_id)
    return Outcome(run_id, done, r.chunks_done, r.chunks_skipped, r.matches, interrupted)


def export_rows(ledger: DataFrame, files: DataFrame, titles: DataFrame, matched_only: bool = True) -> DataFrame:
    """Results with titles as they are now; results of unknown titles stay."""
    d = ledger.where("kind = 'result'")
    d = d.where("matched") if matched_only else d
    d = d.join(files.select("file_id", "imdb_id", "rel_path"), "file_id")
    t = with_parents(titles)
    label = t.select(F.col("imdb_id"), text.display_name().alias("title"), F.col("start_year").alias("year"))
    return d.join(label, "imdb_id", "left").select(
        "imdb_id", F.coalesce("title", "imdb_id").alias("title"), "year", "rel_path", "chunk_index", "first_sentence_index", "last_sentence_index", "first_sentence_id", "last_sentence_id", "matched", "payload", "model"
    ).orderBy("rel_path", "chunk_index")


def export_run(catalog: Catalog, run_id: int, dest: str, fmt: str = "jsonl", matched_only: bool = True) -> int:
    """A folder of JSON lines or CSV, in order; returns the number of lines, counted as they are written."""
    rows = export_rows(catalog.read("ledger").where(F.col("run_id") == run_id), catalog.read("subtitle_files"), catalog.read("titles"), matched_only)
    seen = Observation()
    rows = rows.observe(seen, F.count(F.lit(1)).alias("n"))
    if fmt == "csv":
        rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(dest)
    elif fmt == "jsonl":
        as_json = rows.withColumn("payload", F.try_parse_json("payload"))
        as_json.write.mode("overwrite").option("ignoreNullFields", False).json(dest)
    else:
        raise SearchError(f"unknown export format {fmt!r}")
    return seen.get["n"]


def index_files(catalog: Catalog, entries: DataFrame, release: str, rehash: bool = False) -> int:
    """entries(rel_path, size, language, imdb_id, subtitle_id, year, content or null) into subtitle_files; no text is kept."""
    stamp = F.lit(now())
    sha = F.when(F.col("content").isNotNull(), F.sha2("content", 256)) if "content" in entries.columns and rehash else F.lit(None).cast("string")
    rows = entries.select(
        F.xxhash64(F.lit(release), "language", "rel_path").alias("file_id"), F.lit(release).alias("release"), "language", "imdb_id", F.col("subtitle_id"), "rel_path", "year",
        sha.alias("sha256"), F.col("size").alias("size_bytes"), stamp.alias("updated_at"),
    ).dropDuplicates(["release", "language", "rel_path"])
    old = catalog.read("subtitle_files")
    n = rows.count()
    catalog.upsert("subtitle_files", rows.join(old.select("file_id", "discovered_at"), "file_id", "left").withColumn("discovered_at", F.coalesce("discovered_at", stamp)), ("sha256", "size_bytes"))
    return n


def refresh(catalog: Catalog, hashed: DataFrame, dry_run: bool = False) -> DataFrame:
    """hashed(file_id, sha256): the changes; a changed file loses its ledger rows in all runs, and done runs are paused."""
    found = changes(catalog.read("subtitle_files"), hashed, "file_id", "sha256")
    if dry_run:
        return found
    path = f"{catalog.root}/_refresh-{uuid.uuid4().hex}"
    found.write.parquet(path)
    found = catalog.spark.read.parquet(path)
    changed = found.where("change = 'changed'").select("file_id")
    touched = catalog.read("run_files").join(changed, "file_id", "left_semi").select("run_id").distinct().withColumn("_t", F.lit(True))
    paused = F.when(F.col("_t") & (F.col("status") == "done"), "paused").otherwise(F.col("status"))
    catalog.rewrite("runs", lambda runs: runs.join(touched, "run_id", "left").withColumn("status", paused).drop("_t"))
    for table in ("ledger", "failures"):
        catalog.delete(table, changed, ["file_id"])
    fresh = hashed.select("file_id", F.col("sha256").alias("_h"))
    catalog.rewrite("subtitle_files", lambda old: old.join(fresh, "file_id", "left").withColumn("sha256", F.coalesce("_h", "sha256")).drop("_h"))
    return found


def stale(files: DataFrame, hashed: DataFrame) -> DataFrame:
    """Files whose checksum is missing or isn't that of the member now; hashed(file_id, sha256)."""
    both = files.join(hashed.select("file_id", F.col("sha256").alias("_h")), "file_id", "left")
    return both.where(F.col("sha256").isNull() | F.col("_h").isNotNull() & (F.col("sha256") != F.col("_h"))).drop("_h")


def get_by_path(catalog: Catalog, release: str, language: str, rel_path: str) -> Row | None:
    return catalog.get("subtitle_files", release=release, language=language, rel_path=rel_path)


def set_hash(catalog: Catalog, file_id: int, sha256: str) -> None:
    own = F.col("file_id") == file_id
    catalog.rewrite("subtitle_files", lambda d: d.withColumn("sha256", F.when(own, sha256).otherwise(F.col("sha256"))))
