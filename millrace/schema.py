"""The catalog's tables: fixed schemas, keys and statuses."""

from __future__ import annotations

from pyspark.sql import types as T

VERSION = 2

_L, _I, _S, _B, _T = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType(), T.TimestampType()


def _schema(required: dict[str, T.DataType], optional: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(k, v, False) for k, v in required.items()] + [T.StructField(k, v) for k, v in optional.items()])


TABLES: dict[str, T.StructType] = {
    "titles": _schema(
        {"imdb_id": _S, "is_adult": _B, "source": _S, "imported_at": _T},
        {"title_type": _S, "primary_title": _S, "original_title": _S, "start_year": _I, "end_year": _I, "runtime_minutes": _I, "parent_imdb_id": _S, "season_number": _I, "episode_number": _I},
    ),
    "subtitle_files": _schema(
        {"file_id": _L, "release": _S, "language": _S, "imdb_id": _S, "subtitle_id": _S, "rel_path": _S, "discovered_at": _T, "updated_at": _T},
        {"year": _I, "sha256": _S, "size_bytes": _L, "sentence_count": _L},
    ),
    "runs": _schema({"run_id": _L, "manifest_path": _S, "manifest_hash": _S, "manifest_snapshot": _S, "model": _S, "status": _S, "created_at": _T, "updated_at": _T}, {"finished_at": _T}),
    "run_files": _schema({"run_id": _L, "file_id": _L, "queued_at": _T}, {"sha256": _S}),
    "ledger": _schema(
        {"run_id": _L, "file_id": _L, "chunk_index": _L, "kind": _S, "first_sentence_index": _L, "last_sentence_index": _L, "last_chunk": _B, "matched": _B, "model": _S, "created_at": _T},
        {"first_sentence_id": _S, "last_sentence_id": _S, "payload": _S, "latency_ms": _L, "error": _S},
    ),
    "failures": _schema({"run_id": _L, "file_id": _L, "chunk_index": _L, "session": _S, "created_at": _T}, {"error": _S}),
    "downloads": _schema({"download_id": _L, "corpus": _S, "release": _S, "language": _S, "status": _S}, {"url": _S, "archive_path": _S, "sha256": _S, "downloaded_at": _T, "verified_at": _T}),
    "imports": _schema({"import_id": _L, "source": _S, "file_name": _S, "imported_at": _T}, {"released_at": _S, "row_count": _L}),
}

#: Natural keys, which the writer keeps unique.
KEYS: dict[str, tuple[str, ...]] = {
    "titles": ("imdb_id",),
    "subtitle_files": ("release", "language", "rel_path"),
    "runs": ("run_id",),
    "run_files": ("run_id", "file_id"),
    "ledger": ("run_id", "file_id", "chunk_index"),
    "failures": ("run_id", "file_id", "chunk_index", "session"),
    "downloads": ("corpus", "release", "language"),
    "imports": ("import_id",),
}

#: Tables laid out by directory, so that a release is pruned at the scan.  Those of runs grow by parts, each of one run, and
#: are pruned by the statistics of their files.
PARTITIONS: dict[str, tuple[str, ...]] = {"subtitle_files": ("release", "language")}

#: Tables that lose their rows with a row of another, and the column that they share.
CASCADES: dict[str, tuple[tuple[str, str], ...]] = {
    "runs": (("run_files", "run_id"), ("ledger", "run_id"), ("failures", "run_id")),
    "subtitle_files": (("run_files", "file_id"), ("ledger", "file_id"), ("failures", "file_id")),
}

RUN_STATUSES = ("pending", "running", "paused", "done", "failed")
FILE_STATUSES = ("pending", "in_progress", "done", "skipped", "error")
DOWNLOAD_STATUSES = ("pending", "downloaded", "failed")
