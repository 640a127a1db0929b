import gzip
import json
import signal
import sys
import threading
import time
import uuid
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from millrace import cli, config
from millrace.errors import ArchiveError, CatalogError, ConfigurationError, ManifestError, MetadataError, ModelError, SchemaVersionError, SearchError
from millrace.functions import jsonout, text
from millrace.operators import search, tables
from millrace.plans import flows, manifest
from millrace.sources import releases, titles_tsv, zip_corpus

XML = """<?xml version="1.0"?><!-- holds <s> and <time> --><document id="1">
<s id="1"><time id="T1S" value="00:00:314"/>First   line &amp; more.</s>
<s id="2">Second line.<time id="T1E" value="00:02:118"/></s>
<s id="3"><time id="T2S" value="00:04:002"/>Third line.
<s id="4"/></document>"""


@pytest.fixture
def archive(tmp_path):
    p = tmp_path / "a.zip"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("C/raw/en/", "")
        for i in range(12):
            z.writestr(f"C/raw/en/1999/{133093 + i}/{i}.xml", XML.replace("First", f"File {i}"))
        z.writestr("C/raw/en/1999/1000/1_2_3_1/x.xml", "")
        z.writestr("C/README", "x")
        z.writestr("C/raw/en/1999/0133093/3.xml.gz", "x")
    return str(p)


def test_archive(spark, archive, tmp_path):
    assert zip_corpus.members(spark, archive).count() == 13
    assert zip_corpus.entries(spark, archive, "en").count() == 12 and zip_corpus.rejected(spark, archive) == 1
    every = zip_corpus.members(spark, archive, every=True).withColumn("o", F.monotonically_increasing_id())
    r = zip_corpus.summary(every, 2, order="o").first()
    assert (r.subtitle_count, r.metadata_count, r.unexpected_count, len(r.subtitle_sample)) == (13, 1, 1, 2)
    assert b"File 3" in zip_corpus.open_member(spark, archive, "C/raw/en/1999/133096/3.xml")
    with pytest.raises(ArchiveError):
        zip_corpus.open_member(spark, archive, "no")
    (tmp_path / "b.zip").write_bytes(b"PK")
    for p in ("b.zip", "c.zip"):
        with pytest.raises(ArchiveError):
            zip_corpus.check_archive(str(tmp_path / p))


def test_xml_is_read_in_slices(spark, monkeypatch):
    """A batch of documents is passed on in slices of bounded bytes, and each document is read once, whatever uses its sentences."""
    monkeypatch.setattr(text, "RUN_BYTES", 1000)
    docs = pa.array([XML.encode(), None, b"", b"no sentence"] * 20, pa.binary())
    got = list(text.sentence_lists(docs))
    assert len(got) > 5 and max(len(x) for x in got) <= 20 and sum(map(len, got)) == len(docs)
    rows = [x for g in got for x in g.to_pylist()]
    assert [len(x) for x in rows[::4]] == [4] * 20 and rows[1::4] == [None] * 20 and rows[2::4] == rows[3::4] == [[]] * 20
    d = text.chunked(text.with_sentences(spark.createDataFrame([(1, XML)], "i int, content string")).drop("content"), 2, 1)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp" not in plan
    assert [r.chunk_index for r in d.collect()] == [0, 1, 2]
    # white space is that of ASCII where markup is told apart, as in the JVM, and any where texts are collapsed
    ids, texts, *_ = text.read_xml('<s id="1">a\u00a0 b<s\u00a0id="2">c</s ><S>d<s/>e')
    assert ids == ["1", ""] and texts == ["a bc", ""]


def test_archive_is_read_by_ranges(spark, archive, tmp_path):
    """A task reads its range of the directory, and members by name come by their records: no process opens all of it."""
    names = [r.rel_path for r in zip_corpus.members(spark, archive).collect()]
    want = spark.createDataFrame([(i, n) for i, n in enumerate([*names, "no", None, names[0]])], "i int, rel_path string")
    placed = zip_corpus.placed(want, archive)
    records = {r.rel_path: r.zip_record for r in placed.collect()}
    assert len(records) == 15 and all((n in names) == (r is not None and n.encode() in bytes(r)) for n, r in records.items() if n)
    got = {r.i: r.content for r in zip_corpus.contents(placed, archive).collect()}
    assert len(got) == 16 and got[13] is got[14] is None and got[15] == got[0]
    with zipfile.ZipFile(archive) as z:
        assert all(bytes(got[i]) == z.read(n) for i, n in enumerate(names))
    r = zip_corpus.ZipReader(archive, 4, True, False)
    ranges = r.partitions()
    assert len(ranges) == 4 and not any("names" in vars(x) for x in ranges)
    assert sum(b.num_rows for x in ranges for b in r.read(x)) == 15
    # of two members of one name the last counts; the archive may stand after other bytes
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z, pytest.warns(UserWarning):
        for x in ("a", "b"):
            z.writestr("x.xml", x)
    (tmp_path / "e.zip").write_bytes(b"other" + (tmp_path / "d.zip").read_bytes())
    assert zip_corpus.open_member(spark, str(tmp_path / "e.zip"), "x.xml") == b"b"


def test_archive_is_written_by_tasks(spark, tmp_path, monkeypatch):
    """No content comes to the driver, and what is written is a whole zip."""
    rows = [(f"C/é{i}.xml", f"text {i}\n" * i) for i in range(60)]
    d = spark.createDataFrame(rows, "rel_path string, content string").repartition(5)
    monkeypatch.setattr(type(d), "toLocalIterator", None)
    zip_corpus.written(d, str(tmp_path / "a.zip"), ("C/", "C/README"))
    assert [p.name for p in tmp_path.iterdir()] == ["a.zip"]
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        assert z.testzip() is None and sorted(z.namelist()) == sorted(["C/", "C/README", *dict(rows)])
        assert all(z.read(n).decode() == c for n, c in rows)
    zip_corpus.written(d.limit(0), str(tmp_path / "b.zip"))
    assert zip_corpus.members(spark, str(tmp_path / "b.zip")).count() == 0


def test_xml_sentences(spark):
    rows = text.with_sentences(spark.createDataFrame([(1, XML), (2, "no sentence")], "i int, content string")).collect()
    got = [(s.idx, s.id, s.text, s.start, s.end) for s in rows[0].sentences]
    assert got == [(0, "1", "File line & more.".replace("File", "First"), "00:00:314", "00:02:118"), (1, "2", "Second line.", "00:00:314", "00:02:118"), (2, "3", "Third line.", "00:04:002", None), (3, "4", "", "00:04:002", None)]
    assert rows[1].sentences == []


def test_ids_and_paths(spark):
    d = spark.createDataFrame([("133093",), ("tt0133093",), ("12345678",), ("x",), (None,)], "r string").select(text.title_id(F.col("r"))).collect()
    assert [x[0] for x in d] == ["tt0133093", "tt0133093", "tt12345678", None, None]
    d = spark.createDataFrame([("C/raw/en/1999/1/2.xml",), ("C/raw/en/abc/1/2.xml",), ("C/raw/en/1.xml",)], "p string").select(text.parsed_path(F.col("p")).alias("e")).collect()
    assert d[0].e.year == 1999 and d[1].e.year is None and d[2].e is None


@pytest.mark.parametrize(("size", "overlap"), [(1, 0), (3, 1), (8, 2), (80, 10), (5, 4)])
def test_chunks_match_a_loop(spark, size, overlap):
    d = spark.range(0, 40).select(F.col("id").alias("f"), F.transform(F.when(F.col("id") == 0, F.expr("cast(array() as array<bigint>)")).otherwise(F.sequence(F.lit(1), F.col("id") * 4)), lambda x, i: F.struct(i.cast("long").alias("idx"), x.cast("string").alias("id"), x.cast("string").alias("text"))).alias("sentences"))
    got = {(r.f, r.chunk_index): (r.first_sentence_index, r.last_sentence_index, r.last_chunk) for r in text.chunked(d, size, overlap).collect()}
    want = {}
    for f in range(40):
        n, start, k = 4 * f, 0, 0
        while n and True:
            end = min(start + size, n)
            want[f, k] = (start, end - 1, end == n)
            if end == n:
                break
            start, k = start + size - overlap, k + 1
    assert got == want
    with pytest.raises(ValueError):
        text.check_window(size, size)


def test_prefilter_and_prompt(spark):
    d = spark.createDataFrame([("ÉTÉ a$1",), ("b",)], "t string")
    keep = lambda *a, **k: [r[0] for r in d.select(text.prefilter(F.col("t"), *a, **k)).collect()]
    assert keep("any", ("été",)) == [True, False] and keep("none", ("été",)) == [False, True] and keep("all", ("A", "é")) == [True, False]
    assert keep("any", ("^été",), regex=True) == [True, False] and keep("any", ("a",), case_sensitive=True) == [True, False] and keep("off", ()) == [True, True]
    for bad in ("(", "(?P<x>a)"):
        with pytest.raises(ManifestError):
            keep("any", (bad,), regex=True)
    assert d.select(text.prompt("<{{ t }}|{{n}}>", {"t": F.col("t"), "n": F.lit(None)})).first()[0] == "<ÉTÉ a$1|>"
    with pytest.raises(ManifestError):
        text.prompt("{{ nope }}", {})


SCHEMA = {"type": "object", "properties": {"matched": {"type": "boolean"}, "confidence": {"type": "number", "minimum": 0, "maximum": 1}, "quotes": {"type": "array", "items": {"type": "string"}}}, "required": ["matched"], "additionalProperties": False}


def test_validation(spark):
    cases = [('{"matched": true, "confidence": 0.5, "quotes": ["a"]}', True), ('{"matched": "true"}', None), ("{}", None), ("nope", None), ('{"matched": false, "x": 1}', None), ('{"matched": true, "confidence": 2}', None), ('{"matched": true, "quotes": [1]}', None), ('{"matched": false}', False), (None, None), ("[1]", None)]
    rows = spark.createDataFrame(cases, "r string, want boolean").select(jsonout.validated(F.col("r"), "json", SCHEMA, "matched").alias("v"), "want").collect()
    for r in rows:
        assert (r.v.error is None) == (r.want is not None) and r.v.matched == bool(r.want), r
    with pytest.raises(ManifestError):
        jsonout.check_schema({"oneOf": []})


MANIFEST = "name: n\nmodel: m\nselect: {exclude_adult: false}\nchunk: {size: 2, overlap: 1}\nprefilter: {mode: any, patterns: [line]}\nprompt: {user: '{{ title }}: {{ chunk }}'}\noutput: {schema: {type: object, properties: {matched: {type: boolean}}, required: [matched]}}\nmatch_when: matched\n"


def test_manifest(tmp_path):
    one = manifest.parse(MANIFEST)
    assert manifest.parse(MANIFEST.replace("\n", "\r\n")).hash == one.hash != manifest.parse(MANIFEST + "#\n").hash
    for bad in ("x: 1\n" + MANIFEST, MANIFEST.replace("overlap: 1", "overlap: 2"), MANIFEST.replace("[line]", "[]"), "[1]", "a: ["):
        with pytest.raises(ManifestError):
            manifest.parse(bad)
    with pytest.raises(ManifestError):
        manifest.load(tmp_path / "none.yaml")


def test_search_end_to_end(spark, archive, tmp_path):
    class Fake:  # local, so that it travels to the workers by value
        def complete(self, *, model, user, system=None, options=None, json_schema=None):
            if "File 5" in user:
                raise RuntimeError("down")
            return search.Completion(json.dumps({"matched": "Third" in user}), model, 1)

    c = tables.Catalog(spark, str(tmp_path / "cat"))
    with pytest.raises(CatalogError):
        c.ensure_current()
    assert c.initialize() == c.initialize() == 2
    entries = zip_corpus.entries(spark, archive, content=True)
    assert search.index_files(c, entries, "v1", rehash=True) == 12 == search.index_files(c, entries, "v1", rehash=True) == c.read("subtitle_files").count()

    def sentences(files):
        return text.with_sentences(zip_corpus.contents(files, archive))

    e = search.Engine(c, Fake, sentences, wave=5)
    loaded = manifest.parse(MANIFEST)
    first = e.start(loaded, limit=4)
    assert (first.files_done, first.interrupted) == (4, False) and c.read("runs").first().status == "paused"
    out = e.resume(first.run_id)
    n = c.read("ledger").count()
    assert out.files_done == 11 and out.matches == 24 and out.chunks_done == n == 35
    assert {r.status: r.files for r in search.run_progress(c, 1).collect()} == {"pending": 0, "in_progress": 0, "done": 11, "skipped": 0, "error": 1}
    again = e.resume(first.run_id)
    assert again.chunks_done == n and search.plan_size(c, 1) == (11, 12)
    assert search.export_run(c, 1, str(tmp_path / "out"), "csv") == 24 and search.export_run(c, 1, str(tmp_path / "out2")) == 24
    changed = c.read("subtitle_files").select("file_id", F.when(F.col("rel_path").endswith("/3.xml"), "x").otherwise(F.col("sha256")).alias("sha256"))
    assert search.refresh(c, changed, dry_run=True).count() == 1
    search.refresh(c, changed)
    assert c.read("ledger").count() == n - 3
    assert e.resume(1).chunks_done == n
    for bad in (lambda: e.resume(9), lambda: search.Engine(c, Fake, sentences, concurrency=65)):
        with pytest.raises(SearchError):
            bad()
    before = c.status()
    assert c.read("ledger").groupBy("file_id", "chunk_index").count().where("count > 1").isEmpty()
    c.vacuum(older_than=0)
    assert c.status() == before and before["ledger"] == n
    assert not [f.name for f in (tmp_path / "cat").iterdir() if f.name.startswith("_")]
    assert cli.main(["--catalog", c.root, "db", "status"], spark) == 0 and cli.main(["--catalog", c.root + "x", "db", "status"], spark) == 1
    assert cli.main(["--catalog", c.root, "search", "status", "1"], spark) == 0


def test_titles(spark, tmp_path):
    b, e = tmp_path / "b.tsv", tmp_path / "e.tsv"
    head = "\t".join(titles_tsv.BASICS[1])
    b.write_text(head + '\ntt0000001\ttvSeries\tA "b\tA\t0\t1999\t\\N\t\\N\tx\ntt12345678\ttvEpisode\tE\t\t1\t\\N\t\\N\t30\t\\N\n')
    e.write_text("\t".join(titles_tsv.EPISODES[1]) + "\ntt12345678\ttt0000001\t1\t2\ntt9\ttt8\t1\t1\n")
    c = tables.Catalog(spark, str(tmp_path / "cat"))
    c.initialize()
    with pytest.raises(MetadataError):
        titles_tsv.import_episodes(c, str(e))
    assert titles_tsv.import_basics(c, str(b)) == 2 and titles_tsv.import_episodes(c, str(e)) == 1 and titles_tsv.import_basics(c, str(b)) == 2
    t = {r.imdb_id: r for r in titles_tsv.with_parents(c.read("titles")).withColumn("name", text.display_name()).collect()}
    assert t["tt12345678"].name == 'A "b S01E02 — E' and t["tt12345678"].original_title == "" and t["tt12345678"].is_adult and t["tt0000001"].name == 'A "b (1999)'
    with pytest.raises(MetadataError):
        titles_tsv.rows(spark, str(e), titles_tsv.BASICS[1])


class Reply:
    def __init__(self, status, body=b"", headers=None):
        self.status, self.body, self.headers = status, body, headers or {}

    def blocks(self):
        yield self.body


def test_releases(spark, tmp_path):
    rec = lambda v, s, t="": {"corpus": "C", "version": v, "preprocessing": "raw", "source": s, "target": t, "url": "u", "size": 2, "documents": 1}
    body = json.dumps({"corpora": [rec("v1", "en"), rec("v2024", "en"), rec("v2018", "en"), rec("v1", "en", "fr"), rec("v1", "fr")]}).encode()
    i = releases.records(spark, lambda u, h: Reply(200, body))
    assert [r.version for r in releases.available_versions(i, "en").collect()] == ["v2024", "v2018", "v1"]
    r = releases.resolve(i, "en")
    assert r.version == "v1" and "version=" not in releases.index_url(corpus="C", version=None)
    for f in (lambda: releases.resolve(i, "xx"), lambda: releases.records(spark, lambda u, h: Reply(503)), lambda: releases.records(spark, lambda u, h: Reply(200, b"{}"))):
        with pytest.raises(MetadataError):
            f()
    data = bytes(range(256)) * 8

    def fetch(u, h):
        at = int(h["Range"][6:-1]) if "Range" in h else 0
        return Reply(206 if at else 200, data[at:])

    part = tmp_path / "C_v1_raw_en.zip.part"
    part.write_bytes(data[:512])
    got = releases.download(r, tmp_path, fetch)
    assert got.path.read_bytes() == data and got.sha256 is None and releases.download(r, tmp_path, fetch).skipped
    assert releases.download(r, tmp_path, fetch, force=True).sha256 == releases.sha256_file(got.path)


def test_tables(spark, tmp_path):
    c = tables.Catalog(spark, str(tmp_path / "cat"))
    c.initialize()
    row = lambda **k: spark.createDataFrame([(1, "C", "v", "en", k.get("url"), k.get("sha"), k.get("status", "pending"))], "download_id long, corpus string, release string, language string, url string, sha256 string, status string").withColumn("archive_path", F.lit(None).cast("string"))
    for k in ({"url": "u", "sha": "h"}, {"url": None}):
        c.upsert("downloads", row(**k), ("url", "sha256", "archive_path"))
    r = c.read("downloads").collect()
    assert len(r) == 1 and r[0].sha256 == "h" and r[0].url == "u"
    tables.mark_download(c, 1, "failed")
    assert tables.ordered_downloads(c).first().downloaded_at is None
    tables.mark_download(c, 1, "downloaded", verified=True)
    tables.mark_download(c, 2, "failed")
    r = c.read("downloads").first()
    assert r.status == "downloaded" and r.downloaded_at and r.verified_at and r.sha256 == "h"


def test_stream_takes_a_key_once(spark, tmp_path):
    from millrace.schema import TABLES
    from millrace.streaming.files import arrivals, drain

    c = tables.Catalog(spark, str(tmp_path / "cat"))
    c.initialize()
    rows = spark.range(5).select(F.col("id").alias("run_id"), F.col("id").alias("file_id"), F.current_timestamp().alias("queued_at"), F.lit("x").alias("sha256"))
    for _ in range(2):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        drain(arrivals(spark, str(tmp_path / "in"), TABLES["run_files"], ["run_id", "file_id"]), c, "run_files", str(tmp_path / "ck"))
    assert c.read("run_files").count() == 5


class Counting:
    """Counts its calls in files, since it lives in the tasks; breaks on prompts that name bad."""

    def __init__(self, folder, bad="", wait=0.0):
        self.folder, self.bad, self.wait = folder, bad, wait

    def complete(self, *, model, user, system=None, options=None, json_schema=None):
        (self.folder / uuid.uuid4().hex).write_text(user)
        time.sleep(self.wait)
        if self.bad and self.bad in user:
            raise RuntimeError("down")
        return search.Completion('{"matched": true}', model, 1)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the tasks can't import this module


@pytest.fixture
def shelf(spark, tmp_path):
    """Six files of one chunk, the first of which breaks the client."""
    c = tables.Catalog(spark, str(tmp_path / "cat"))
    c.initialize()
    entries = spark.createDataFrame([(f"C/raw/en/1999/{i}/{i}.xml", 1, "en", f"tt000000{i}", str(i), 1999) for i in range(6)], "rel_path string, size long, language string, imdb_id string, subtitle_id string, year int")
    search.index_files(c, entries, "v1")
    (tmp_path / "calls").mkdir()
    return c, tmp_path / "calls", lambda f: text.plain_sentences(f.withColumn("text", F.concat(F.lit("file "), "subtitle_id"))).drop("text")


ONE = "name: n\nmodel: m\nselect: {exclude_adult: false}\nprompt: {user: '{{ chunk }}'}\noutput: {schema: {type: object, properties: {matched: {type: boolean}}}}\nmatch_when: matched\n"


@pytest.mark.parametrize("wave", [1, 2])
def test_failing_file_starves_none(shelf, wave):
    """Every chunk is called once a run, the failing one too; a resumed run calls the failing one alone."""
    c, calls, sentences = shelf
    out = search.Engine(c, lambda: Counting(calls, "file 0"), sentences, wave=wave).start(manifest.parse(ONE))
    assert (out.files_done, out.chunks_done, len(list(calls.iterdir()))) == (5, 5, 6)
    assert c.count("failures") == 1 and c.get("runs", run_id=1).status == "paused"
    assert {r.status: r.files for r in search.run_progress(c, 1).collect()}["error"] == 1
    out = search.Engine(c, lambda: Counting(calls), sentences, wave=wave).resume(1)
    assert (out.files_done, out.chunks_done, len(list(calls.iterdir()))) == (6, 6, 7) and c.get("runs", run_id=1).status == "done"
    assert search.results(c, 1).count() == 6 == c.read("ledger").select("file_id", "chunk_index").distinct().count()


def test_waves_stop_in_time(shelf):
    """A pass leaves what its time doesn't allow to the next; a stop request keeps the answers of the pass under way."""
    c, calls, sentences = shelf
    e = search.Engine(c, lambda: Counting(calls, wait=0.4), sentences, concurrency=1, wave_seconds=0.5)
    e.request_stop()
    assert e.start(manifest.parse(ONE)) == search.Outcome(1, 0, 0, 0, 0, True) and not list(calls.iterdir())
    at = e._pass
    e._pass = lambda *a: (at(*a), e.request_stop())[0]
    out = e.resume(1)
    assert out.interrupted and 0 < out.chunks_done < 6 and out.chunks_done == len(list(calls.iterdir()))
    e._pass = at
    assert e.resume(1).chunks_done == 6 == len(list(calls.iterdir()))


def test_waves_read_their_own_files(spark, tmp_path):
    """The table of texts is read once a run, and not again by each wave; what lies with the waves goes with the run."""
    d = str(tmp_path / "d")
    spark.createDataFrame([(i, f"license {i}\nline", "en", "s") for i in range(1, 8)], "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(1, 8)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    c = flows.filled(spark, d)
    e, read, placed = flows.engine(spark, d, c), [], []
    e.wave, own, all_ = 1, e.sentences, e.placed
    e.sentences = lambda f: (read.append(own(f).inputFiles()), own(f))[1]
    e.placed = lambda f: (placed.append(1), all_(f))[1]
    out = e.start(manifest.parse(flows.SOURCE))
    assert (out.files_done, out.matches, len(placed)) == (7, 7, 1) and len(read) > 1
    assert not [f for fs in read for f in fs if "documents.parquet" in f]
    assert not [f.name for f in Path(c.root.removeprefix("file:")).iterdir() if f.name.startswith("_work")]


def test_files_without_text(shelf):
    c, calls, _ = shelf
    empty = lambda f: text.plain_sentences(f.withColumn("text", F.when(F.col("subtitle_id") != "1", F.when(F.col("subtitle_id") == "2", F.lit(" \n")).otherwise(F.lit("a"))))).drop("text")
    out = search.Engine(c, lambda: Counting(calls), empty).start(manifest.parse(ONE))
    status = {r.subtitle_id: r.status for r in search.run_files(c, 1).join(c.read("subtitle_files"), "file_id").collect()}
    assert status == {"0": "done", "1": "error", "2": "done", "3": "done", "4": "done", "5": "done"} and out.chunks_done == 4


def test_pointers(spark, tmp_path):
    """A write that breaks off before its pointer changes nothing, and initialising again changes nothing either; of two
    writers from one pointer only one gets through, and the other starts again."""
    c = tables.Catalog(spark, str(tmp_path / "cat"))
    c.initialize()
    rows = lambda *ids: spark.createDataFrame([(1, i, None) for i in ids], "run_id long, file_id long, sha256 string").withColumn("queued_at", F.current_timestamp())
    c.append("run_files", rows(1))
    publish, c._publish = c._publish, lambda *a: (_ for _ in ()).throw(OSError("gone"))
    with pytest.raises(OSError):
        c.append("run_files", rows(2))
    c._publish = publish
    c.initialize()
    assert [r.file_id for r in c.read("run_files").collect()] == [1]
    base, parts = c._snapshot("run_files")
    assert c._move("run_files", base, parts) and not c._move("run_files", base, [])
    other, store = tables.Catalog(spark, c.root), c._store
    c._store = lambda *a: (store(*a), setattr(c, "_store", store), other.append("run_files", rows(7)))[0]  # comes in between
    assert c.insert_missing("run_files", rows(1, 7, 8)) == 1
    assert sorted(r.file_id for r in c.read("run_files").collect()) == [1, 7, 8]
    for i in range(40):
        c.append_part("run_files", store("run_files", rows(100 + i)))
    assert c.count("run_files") == 43 and len(c._snapshot("run_files")[1]) < tables.SMALL_PARTS
    assert c.delete("run_files", rows(1), ["file_id"]) == 1
    (tmp_path / "cat" / "meta-9.json").write_text("{}")
    with pytest.raises(SchemaVersionError):
        c.initialize()


def test_command_line(spark, archive, tmp_path, monkeypatch, capsys):
    """Every command, from an empty folder to an export."""
    monkeypatch.chdir(tmp_path)
    head = lambda h: "\t".join(h) + "\n"
    lists = {
        titles_tsv.BASICS[0]: head(titles_tsv.BASICS[1]) + "".join(f"tt0{133093 + i}\tmovie\tT{i}\t\\N\t0\t1999\t\\N\t\\N\t\\N\n" for i in range(11)),
        titles_tsv.EPISODES[0]: head(titles_tsv.EPISODES[1]) + "tt0133094\ttt0133093\t1\t2\n",
    }
    record = {"corpus": "OpenSubtitles", "version": "v2024", "preprocessing": "raw", "source": "en", "target": "", "url": "http://x/a.zip", "size": 3, "documents": 1}
    status = {"lists": 503}

    def fetch(url, headers):
        if url.startswith(releases.INDEX_URL):
            return Reply(200, json.dumps({"corpora": [record]}).encode())
        if url == record["url"]:
            return Reply(200, open(archive, "rb").read())
        return Reply(status["lists"], gzip.compress(lists[url.rsplit("/", 1)[1]].encode()))

    (tmp_path / "m.yaml").write_text(MANIFEST.replace("exclude_adult: false", "exclude_adult: true"))
    run = lambda *a: (cli.main(["--catalog", str(tmp_path / "cat"), *a], spark, fetch, Local), capsys.readouterr().out)

    class Local:
        def complete(self, *, model, user, system=None, options=None, json_schema=None):
            return search.Completion(json.dumps({"matched": "Third" in user}), model, 1)

    assert run("db", "status")[0] == 1 and run("db", "init")[0] == 0 and run("corpus", "index")[0] == 1
    assert run("search", "run", "m.yaml")[0] == 1  # no archive
    assert run("corpus", "fetch", "--hash") == (0, "http://x/a.zip (3 KB)\n13 subtitles, 1 service files, 1 others\n")
    assert run("corpus", "index", "--rehash")[1] == "12 files, 1 names left out\n" and run("corpus", "refresh", "--dry-run") == (0, "")
    assert run("metadata", "fetch-imdb")[0] == 1 and not list((tmp_path / "data" / "downloads").glob("*.tsv.gz"))
    status["lists"] = 200
    assert run("metadata", "fetch-imdb")[0] == 0 and run("metadata", "import-imdb")[1] == "11 1\n"
    code, out = run("search", "run", "m.yaml", "--limit", "3")
    assert code == 0 and "files_done=3" in out and "1 paused" in run("search", "status")[1]
    assert "files_done=11" in run("search", "resume", "1", "--concurrency", "2")[1] and "done 11" in run("search", "status", "1")[1]
    assert run("search", "resume", "1")[0] == 1 and run("search", "resume", "5")[0] == 1 and run("search", "export", "5")[0] == 1
    for fmt in ("jsonl", "csv"):
        assert run("search", "export", "1", "--format", fmt, "--dest", str(tmp_path / fmt))[1].startswith("22 ")
    assert run("db", "vacuum", "--older-than", "0")[0] == 0 and "ledger: " in run("db", "status")[1]


def test_interrupt_asks_to_stop():
    asked = []
    e = SimpleNamespace(request_stop=lambda: asked.append(1))
    old = signal.getsignal(signal.SIGINT)
    with cli.stoppable(e):
        signal.raise_signal(signal.SIGINT)
        assert asked == [1] and signal.getsignal(signal.SIGINT) is old
    assert signal.getsignal(signal.SIGINT) is old


def test_http_client():
    class Handler(BaseHTTPRequestHandler):
        tries = 0

        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            Handler.tries += 1
            known = body["model"] == "m"
            self.send_response(200 if known and (self.path == "/api/show" or Handler.tries > 2) else 500)
            self.end_headers()
            if known:
                self.wfile.write(json.dumps({"message": {"content": body.get("messages", [{}])[-1].get("content", "")}}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = search.HttpClient(f"http://127.0.0.1:{server.server_port}", 5)
    client.ensure_model("m")
    assert client.complete(model="m", user="hi", system="s").text == "hi" and Handler.tries == 3
    for f in (lambda: client.ensure_model("x"), lambda: client.complete(model="x", user="hi")):
        with pytest.raises(ModelError):
            f()
    server.shutdown()


def test_transfer_cases(tmp_path, caplog):
    """A forced transfer over a stale part, a part that is whole already, an error status, a size that doesn't fit."""
    r = SimpleNamespace(corpus="C", version="v1", preprocessing="raw", source="en", url="u", size=2)
    data, seen = bytes(range(256)) * 8, []

    def fetch(u, h):
        at = int(h["Range"][6:-1]) if "Range" in h else 0
        return Reply(416) if at >= len(data) else Reply(206 if at else 200, data[at:], {"Content-Range": f"bytes {at}-/{len(data)}"} if at else {"content-length": str(len(data))})

    part = tmp_path / "C_v1_raw_en.zip.part"
    part.write_bytes(b"stale")
    got = releases.download(r, tmp_path, fetch, force=True, progress=lambda done, whole: seen.append((done, whole)))
    assert got.path.read_bytes() == data and got.sha256 and seen == [(2048, 2048)] and not caplog.records
    got.path.rename(part)
    assert releases.download(r, tmp_path, fetch).path.read_bytes() == data
    got.path.unlink()
    part.write_bytes(data[:512])
    releases.download(r, tmp_path, fetch, progress=lambda done, whole: seen.append((done, whole)))
    assert seen[-1] == (2048, 2048)
    got.path.unlink()
    with pytest.raises(ArchiveError):
        releases.download(r, tmp_path, lambda u, h: Reply(500))
    r.size = 9
    releases.download(r, tmp_path, fetch)
    assert "announced" in caplog.text


def test_settings(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# x\nMILLRACE_CONCURRENCY=7\nMILLRACE_CATALOG='/c'\n")
    monkeypatch.setenv("MILLRACE_MODEL_TIMEOUT", "2.5")
    s = config.load(str(tmp_path / ".env"))
    assert (s.concurrency, s.catalog_path, s.model_timeout) == (7, "/c", 2.5) and config.Settings().catalog_path == "data/catalog"
    monkeypatch.setenv("MILLRACE_CONCURRENCY", "65")
    with pytest.raises(ConfigurationError):
        config.load(None)


def test_lookups(spark, tmp_path):
    c = tables.Catalog(spark, str(tmp_path / "cat"))
    c.initialize()
    t = [("tt1", "A", None, False), ("tt2", "B", "tt1", False), ("tt3", None, "tt9", True)]
    c.insert_missing("titles", spark.createDataFrame(t, "imdb_id string, primary_title string, parent_imdb_id string, is_adult boolean").withColumns({"source": F.lit("x"), "imported_at": F.current_timestamp(), **{k: F.lit(None) for k in ("title_type", "original_title", "start_year", "end_year", "runtime_minutes", "season_number", "episode_number")}}))
    got = [titles_tsv.resolve(c.read("titles"), f"tt{i}") for i in (1, 2, 3, 4)]
    assert [x and (x.primary_title, x.parent_title) for x in got] == [("A", None), ("B", "A"), (None, None), None]
    assert c.get("titles", imdb_id="tt3").is_adult and c.get("titles", imdb_id="x") is None and c.count("titles", is_adult=True) == 1
    files = spark.createDataFrame([(1, None), (2, "a"), (3, "b"), (4, "c")], "file_id long, sha256 string")
    assert sorted(r.file_id for r in search.stale(files, spark.createDataFrame([(1, "x"), (2, "a"), (3, "z")], "file_id long, sha256 string")).collect()) == [1, 3]
