"""The release index and the transfer of an archive.  Network access is an injected fetcher, so tests need none."""

from __future__ import annotations

import hashlib
import json
import logging
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import ArchiveError, MetadataError
from millrace.functions.text import version_key

log = logging.getLogger("millrace")
INDEX_URL = "https://opus.nlpl.eu/opusapi/"
SCHEMA = "ordinal long, corpus string, version string, preprocessing string, source string, target string, url string, size long"
FIELDS = ("corpus", "version", "preprocessing", "source", "target", "url", "size")
BLOCK = 1 << 20


class Response(Protocol):
    status: int
    headers: dict[str, str]

    def blocks(self) -> Iterator[bytes]: ...


Fetch = Callable[[str, dict[str, str]], Response]


class _Http:
    def __init__(self, raw) -> None:  # noqa: ANN001
        self.raw, self.status, self.headers = raw, raw.status, dict(raw.headers)

    def blocks(self) -> Iterator[bytes]:
        while block := self.raw.read(BLOCK):
            yield block


def http_fetch(url: str, headers: dict[str, str]) -> Response:
    try:
        return _Http(urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=60))
    except urllib.error.HTTPError as e:
        return _Http(e)


def index_url(**criteria: str | None) -> str:
    """Empty criteria are left out: an empty version matches nothing."""
    return INDEX_URL + "?" + urllib.parse.urlencode({k: v for k, v in criteria.items() if v})


def records(spark: SparkSession, fetch: Fetch, corpus: str | None = None, version: str | None = None, language: str | None = None, preprocessing: str | None = None) -> DataFrame:
    url = index_url(corpus=corpus, version=version, source=language, preprocessing=preprocessing)
    r = fetch(url, {})
    if r.status != 200:
        raise MetadataError(f"{url}: status {r.status}")
    try:
        got = json.loads(b"".join(r.blocks()))["corpora"]
        data = [(i, *(x[f] for f in FIELDS)) for i, x in enumerate(got)]
    except (ValueError, KeyError, TypeError) as e:
        raise MetadataError(f"{url}: not a release index: {e}") from e
    return spark.createDataFrame(data, SCHEMA)


def monolingual(index: DataFrame, language: str) -> DataFrame:
    return index.where((F.col("target") == "") & (F.col("source") == language))


def available_versions(index: DataFrame, language: str) -> DataFrame:
    return monolingual(index, language).select("version").distinct().orderBy(F.desc(version_key(F.col("version"))), F.desc("version"))


def resolve(index: DataFrame, language: str):  # noqa: ANN201
    """The first matching record; none is an error that says what there is, several are warned of."""
    own = monolingual(index, language).orderBy("ordinal").limit(2).collect()
    if not own:
        raise MetadataError(f"no archive for {language!r}; there are {describe(index)}")
    if len(own) > 1:
        log.warning("several archives match; taking %s", own[0].url)
    return own[0]


def describe(index: DataFrame, limit: int = 12) -> str:
    r = index.agg(F.array_sort(F.collect_set("version")).alias("v"), F.array_sort(F.collect_set(F.when(F.col("target") == "", F.col("source")))).alias("l")).first()
    some = lambda x: ", ".join(x[:limit]) + (f" (of {len(x)})" if len(x) > limit else "")
    return f"versions {some(r.v) or 'none'}; languages {some(r.l) or 'none'}"


def archive_name(record) -> str:  # noqa: ANN001
    return f"{record.corpus}_{record.version}_{record.preprocessing}_{record.source}.zip"


def total_size(headers: dict[str, str], resumed: int) -> int | None:
    h = {k.lower(): v for k, v in headers.items()}
    if (whole := h.get("content-range", "").rpartition("/")[2]).isdigit():
        return int(whole)
    return resumed + int(h["content-length"]) if h.get("content-length", "").isdigit() else None


@dataclass(frozen=True)
class Download:
    path: Path
    sha256: str | None
    skipped: bool


def download(record, dest: Path, fetch: Fetch, force: bool = False, progress: Callable[[int, int | None], None] | None = None) -> Download:  # noqa: ANN001
    """Transfer to a .part file that a later call continues; the final name appears when all is there.  The hash is known
    when the transfer began at the first byte."""
    dest.mkdir(parents=True, exist_ok=True)
    path = dest / archive_name(record)
    if path.exists() and not force:
        return Download(path, None, True)
    part = path.with_suffix(".zip.part")
    if force:
        part.unlink(missing_ok=True)
    have = part.stat().st_size if part.exists() else 0
    r = fetch(record.url, {"Range": f"bytes={have}-"} if have else {})
    if r.status == 416:
        part.rename(path)
        return Download(path, None, False)
    if r.status not in (200, 206):
        raise ArchiveError(f"{record.url}: status {r.status}")
    if r.status == 200:
        have = 0
    whole, digest, done = total_size(r.headers, have), hashlib.sha256(), have
    with part.open("ab" if have else "wb") as out:
        for block in r.blocks():
            out.write(block)
            digest.update(block)
            done += len(block)
            if progress:
                progress(done, whole)
    part.rename(path)
    if record.size and abs(done - record.size * 1024) > 0.01 * record.size * 1024:
        log.warning("%s: %d bytes came, about %d were announced", path.name, done, record.size * 1024)
    return Download(path, None if have else digest.hexdigest(), False)


def sha256_file(path: str | Path, block: int = BLOCK) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(block):
            digest.update(chunk)
    return digest.hexdigest()
