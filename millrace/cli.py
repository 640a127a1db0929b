"""Command line: db, corpus, metadata and search."""

from __future__ import annotations

import argparse
import dataclasses
import logging
import signal
import sys
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from millrace import __version__, config
from millrace.errors import MillraceError, SearchError
from millrace.functions import text
from millrace.operators import search, tables
from millrace.plans import manifest
from millrace.sources import releases, titles_tsv, zip_corpus


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--catalog")
    p.add_argument("--log-level")
    groups = p.add_subparsers(dest="group", required=True)

    def command(group: argparse._SubParsersAction, name: str, fn, *args: tuple) -> None:  # noqa: ANN001
        c = group.add_parser(name)
        for flags, how in args:
            c.add_argument(*flags, **how)
        c.set_defaults(fn=fn)

    flag = {"action": "store_true"}
    limit = (("--limit",), {"type": int})
    db = groups.add_parser("db").add_subparsers(dest="command", required=True)
    command(db, "init", db_init)
    command(db, "status", db_status)
    command(db, "vacuum", db_vacuum, (("--no-analyze",), flag), (("--older-than",), {"type": float, "default": 3600.0}))
    corpus = groups.add_parser("corpus").add_subparsers(dest="command", required=True)
    command(corpus, "fetch", corpus_fetch, (("--corpus",), {}), (("--release",), {}), (("--language",), {}), (("--force",), flag), (("--hash",), flag))
    command(corpus, "index", corpus_index, (("--rehash",), flag), (("--language",), {}))
    command(corpus, "refresh", corpus_refresh, (("--dry-run",), flag))
    meta = groups.add_parser("metadata").add_subparsers(dest="command", required=True)
    command(meta, "fetch-imdb", metadata_fetch, (("--force",), flag))
    command(meta, "import-imdb", metadata_import)
    s = groups.add_parser("search").add_subparsers(dest="command", required=True)
    conc = (("--concurrency",), {"type": int})
    command(s, "run", search_run, (("manifest",), {}), limit, conc)
    command(s, "resume", search_resume, (("run_id",), {"type": int}), limit, conc)
    command(s, "status", search_status, (("run_id",), {"type": int, "nargs": "?"}))
    command(s, "export", search_export, (("run_id",), {"type": int}), (("--format",), {"choices": ("jsonl", "csv"), "default": "jsonl"}), (("--dest",), {}), (("--all",), flag))
    return p


class Context:
    def __init__(self, args: argparse.Namespace, spark: SparkSession | None = None, fetch: releases.Fetch = releases.http_fetch, client: Callable[[], search.Client] | None = None) -> None:
        self.client = client
        self.settings = config.load()
        if args.catalog:
            self.settings = dataclasses.replace(self.settings, catalog=args.catalog)
        self.spark = spark or SparkSession.builder.appName("millrace").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        self.fetch = fetch
        self.catalog = tables.Catalog(self.spark, self.settings.catalog_path)

    def download(self) -> Row:
        """The newest archive that is there."""
        row = tables.ordered_downloads(self.catalog).where("status = 'downloaded' and archive_path is not null").head()
        if row is None:
            raise MillraceError("no archive: fetch one first")
        return row

    def archive(self) -> str:
        return self.download().archive_path


def db_init(c: Context, a: argparse.Namespace) -> None:
    print(f"schema {c.catalog.initialize()} at {c.catalog.root}")


def db_status(c: Context, a: argparse.Namespace) -> None:
    c.catalog.ensure_current()
    for k, v in c.catalog.status().items():
        print(f"{k}: {v}")


def db_vacuum(c: Context, a: argparse.Namespace) -> None:
    c.catalog.vacuum(not a.no_analyze, a.older_than)


def corpus_fetch(c: Context, a: argparse.Namespace) -> None:
    c.catalog.ensure_current()
    s = c.settings
    lang = a.language or s.language
    index = releases.records(c.spark, c.fetch, a.corpus or s.corpus, a.release or s.release, lang, "raw")
    r = releases.resolve(index, lang)
    print(f"{r.url} ({r.size} KB)")
    row = c.spark.range(1).select(F.xxhash64(*map(F.lit, (r.corpus, r.version, lang))).alias("download_id"), *[F.lit(v).alias(k) for k, v in (("corpus", r.corpus), ("release", r.version), ("language", lang), ("url", r.url), ("status", "pending"))], *[F.lit(None).cast("string").alias(k) for k in ("archive_path", "sha256")])
    c.catalog.upsert("downloads", row, ("url", "archive_path", "sha256", "download_id"))
    own = c.catalog.get("downloads", corpus=r.corpus, release=r.version, language=lang).download_id
    try:
        got = releases.download(r, s.downloads_dir, c.fetch, a.force)
        zip_corpus.check_archive(str(got.path))
        counts = zip_corpus.summary(zip_corpus.members(c.spark, str(got.path), every=True)).first()
    except Exception:
        tables.mark_download(c.catalog, own, "failed")
        raise
    sha = got.sha256 or (releases.sha256_file(got.path) if a.hash else None)
    tables.mark_download(c.catalog, own, "downloaded", sha, str(got.path), verified=True)
    print(f"{counts.subtitle_count} subtitles, {counts.metadata_count} service files, {counts.unexpected_count} others")


def corpus_index(c: Context, a: argparse.Namespace) -> None:
    c.catalog.ensure_current()
    got = c.download()
    d = zip_corpus.entries(c.spark, got.archive_path, a.language, content=a.rehash)
    print(f"{search.index_files(c.catalog, d, got.release, a.rehash)} files, {zip_corpus.rejected(c.spark, got.archive_path)} names left out")


def corpus_refresh(c: Context, a: argparse.Namespace) -> None:
    c.catalog.ensure_current()
    hashed = zip_corpus.members(c.spark, c.archive(), content=True).select("rel_path", F.sha2("content", 256).alias("sha256"))
    known = c.catalog.read("subtitle_files").select("file_id", "rel_path")
    for row in search.refresh(c.catalog, hashed.join(known, "rel_path").select("file_id", "sha256"), a.dry_run).groupBy("change").count().collect():
        print(f"{row.change}: {row['count']}")


def metadata_fetch(c: Context, a: argparse.Namespace) -> None:
    for path in titles_tsv.fetch(c.settings.downloads_dir, c.fetch, a.force):
        print(path)


def metadata_import(c: Context, a: argparse.Namespace) -> None:
    c.catalog.ensure_current()
    print(titles_tsv.import_basics(c.catalog, str(c.settings.downloads_dir / titles_tsv.BASICS[0])), titles_tsv.import_episodes(c.catalog, str(c.settings.downloads_dir / titles_tsv.EPISODES[0])))


def _engine(c: Context, concurrency: int | None) -> search.Engine:
    s = c.settings
    archive = c.archive()
    host, timeout = s.model_host, s.model_timeout
    make = c.client or (lambda: search.HttpClient(host, timeout))
    ensure = None if c.client else search.HttpClient(host, timeout).ensure_model
    return search.Engine(c.catalog, make, lambda files: text.with_sentences(zip_corpus.contents(files, archive)), concurrency or s.concurrency, ensure_model=ensure, placed=lambda files: zip_corpus.placed(files, archive))


@contextmanager
def stoppable(engine: search.Engine) -> Iterator[None]:
    """An interrupt asks the engine to stop and keeps what it has; a second one breaks off."""

    def stop(number: int, frame: object) -> None:
        signal.signal(signal.SIGINT, old)
        print("stopping after the calls under way; interrupt again to break off", file=sys.stderr)
        engine.request_stop()

    if threading.current_thread() is not threading.main_thread():  # signals belong to the main thread
        yield
        return
    old = signal.signal(signal.SIGINT, stop)
    try:
        yield
    finally:
        signal.signal(signal.SIGINT, old)


def search_run(c: Context, a: argparse.Namespace) -> None:
    loaded = manifest.load(a.manifest)
    engine = _engine(c, a.concurrency)
    with stoppable(engine):
        print(engine.start(loaded, a.limit))


def search_resume(c: Context, a: argparse.Namespace) -> None:
    engine = _engine(c, a.concurrency)
    with stoppable(engine):
        print(engine.resume(a.run_id, a.limit))


def search_status(c: Context, a: argparse.Namespace) -> None:
    c.catalog.ensure_current()
    if a.run_id is None:
        for r in search.list_runs(c.catalog).collect():
            print(r.run_id, r.status, r.manifest_path)
    else:
        for r in search.run_progress(c.catalog, a.run_id).collect():
            print(r.status, r.files)


def search_export(c: Context, a: argparse.Namespace) -> None:
    if c.catalog.get("runs", run_id=a.run_id) is None:
        raise SearchError(f"no run {a.run_id}")
    dest = a.dest or str(Path(c.settings.exports_dir) / f"run-{a.run_id}.{a.format}")
    print(search.export_run(c.catalog, a.run_id, dest, a.format, not a.all), dest)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, fetch: releases.Fetch = releases.http_fetch, client: Callable[[], search.Client] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=(args.log_level or "INFO").upper())
    try:
        args.fn(Context(args, spark, fetch, client), args)
    except MillraceError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
