"""Every operator of the engine as a query over the driver tables, with the SQL that gives the same rows.

Adapters: documents are subtitle files (a sentence is a trimmed line that isn't empty), labels are titles, pages are
member names, conversations are files whose sentences are turns, events are model answers and ledger rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import jsonout, text
from millrace.operators import tables
from millrace.operators.search import counters, select_files, unresolved
from millrace.plans.manifest import Manifest, Prefilter, PrefilterMode, Select, Years
from millrace.schema import FILE_STATUSES
from millrace.sources.releases import available_versions, monolingual
from millrace.sources.titles_tsv import with_parents
from millrace.sources.zip_corpus import summary

SIZE, OVERLAP = 8, 2
WORDS = ("license", "ation")


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    year = (1950 + F.col("doc_id") % 75).cast("int")
    path = F.concat(F.lit("corpus/raw/"), "lang", F.lit("/"), year.cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".xml"))
    return _t(spark, d, "documents").select(F.col("doc_id").alias("file_id"), text.title_id(F.col("doc_id").cast("string")).alias("imdb_id"), F.col("lang").alias("language"), year.alias("year"), path.alias("rel_path"), "text")


def titles(spark: SparkSession, d: str) -> DataFrame:
    episode = F.col("quality") == 0
    tid = lambda c: text.title_id(c.cast("string"))
    return _t(spark, d, "labels").select(
        tid(F.col("doc_id")).alias("imdb_id"), F.when(F.col("quality") == 1, "movie").otherwise("tvEpisode").alias("title_type"), F.concat(F.lit("Title "), F.col("doc_id").cast("string")).alias("primary_title"),
        F.lit(None).cast("string").alias("original_title"), (1950 + F.col("doc_id") % 75).cast("int").alias("start_year"), (F.col("toxic") == 1).alias("is_adult"), F.when(episode, tid(F.expr("doc_id div 2"))).alias("parent_imdb_id"),
        F.when(episode, (F.col("doc_id") % 9 + 1).cast("int")).alias("season_number"), F.when(episode, (F.col("doc_id") % 24 + 1).cast("int")).alias("episode_number"),
    )


def chunks(df: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    d = text.chunked(text.plain_sentences(df), size, overlap)
    return d.withColumn("txt", text.rendered(F.col("sents"), with_ids=False)).drop("text", "sents")


def q_normalize_id(s, d):
    return _t(s, d, "documents").select("doc_id", text.title_id(F.col("doc_id").cast("string")).alias("imdb_id"))


def q_parse_path(s, d):
    e = files(s, d).select("rel_path", text.parsed_path(F.col("rel_path")).alias("e"))
    return e.select("rel_path", "e.language", "e.year", "e.imdb_id", F.col("e.subtitle_id").alias("file_key"))


def q_member_summary(s, d):
    return summary(_t(s, d, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("rel_path")), suffix=".html")


def q_catalog_index(s, d):
    return files(s, d).select("file_id", "rel_path", F.sha2(F.col("text"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"))


def q_sentences(s, d):
    return text.exploded(text.plain_sentences(files(s, d))).select("file_id", F.col("s.idx").alias("sentence_index"), F.col("s.text").alias("text"))


def q_sentence_count(s, d):
    return text.plain_sentences(files(s, d)).select("file_id", F.size("sentences").cast("long").alias("sentence_count"))


def q_chunks(s, d):
    return chunks(files(s, d)).select("file_id", "chunk_index", "first_sentence_index", "last_sentence_index", F.sha2("txt", 256).alias("txt_sha"))


def q_chunk_count_80_10(s, d):
    n = F.size("sentences").cast("long")
    return text.plain_sentences(files(s, d)).select("file_id", text.chunk_count(n, 80, 10).alias("chunk_count"))


def q_chunk_render_ids(s, d):
    c = text.chunked(text.plain_sentences(files(s, d)), SIZE, OVERLAP)
    return c.select("file_id", "chunk_index", F.sha2(text.rendered(F.col("sents")), 256).alias("sha"))


def _prefilter(mode: str, patterns: tuple[str, ...] = WORDS, **how: bool) -> Callable[[SparkSession, str], DataFrame]:
    p = Prefilter(mode=PrefilterMode(mode), patterns=patterns, **how)
    return lambda s, d: chunks(files(s, d)).where(p.keeps(F.col("txt"))).select("file_id", "chunk_index")


def q_select_files(s, d):
    sel = Select(languages=("en", "fr"), title_types=("movie",), years=Years(min=1960, max=2000))
    return select_files(files(s, d).drop("year"), titles(s, d), sel).select("file_id", "rel_path")


def q_select_unresolved(s, d):
    return unresolved(files(s, d), titles(s, d)).select("file_id")


def q_select_imdb_ids(s, d):
    # the list as a manifest states it
    ids = [r[0] for r in _t(s, d, "benchmark").select(text.title_id(F.col("item_id").cast("string"))).collect()]
    return select_files(files(s, d).drop("year"), titles(s, d), Select(languages=("en", "fr", "de", "es"), exclude_adult=False, imdb_ids=tuple(ids))).select("file_id")


def q_title_parent(s, d):
    return with_parents(titles(s, d)).select("imdb_id", "primary_title", "parent_title")


def q_title_display(s, d):
    return with_parents(titles(s, d)).select("imdb_id", text.display_name().alias("display_name"))


def q_prompt_render(s, d):
    c = chunks(files(s, d).drop("year")).join(titles(s, d), "imdb_id", "left")
    v = {"title": F.coalesce("primary_title", "imdb_id"), "year": F.col("start_year"), "chunk": F.col("txt")}
    return c.select("file_id", "chunk_index", F.sha2(text.prompt("Title: {{ title }} ({{ year }})\n{{ chunk }}", v), 256).alias("prompt_sha"))


def q_validate_output(s, d):
    schema = {"type": "object", "properties": {"k": {"type": "integer"}}, "required": ["k"]}
    e = _t(s, d, "events").select("event_id", "props", jsonout.validated(F.col("props"), "json", schema).alias("v")).where("v.error is null")
    k = F.get_json_object("v.payload", "$.k").cast("long")
    return e.select("event_id", k.alias("k"), (k >= 50).alias("matched"))


def q_insert_ignore(s, d):
    return tables.first_wins(_t(s, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


def q_upsert_coalesce(s, d):
    docs = _t(s, d, "documents")
    old = docs.where("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.sha2("text", 256)).alias("sha"), F.lit("downloaded").alias("status"))
    new = docs.where("doc_id % 4 <> 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).alias("sha"), F.lit("pending").alias("status"))
    return tables.merge(old, new, ["doc_id"], ("sha",))


def q_refresh_diff(s, d):
    docs = _t(s, d, "documents")
    old = docs.where("doc_id % 10 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    new = docs.where("doc_id % 11 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return tables.changes(old, new, "doc_id", "h")


def q_run_progress(s, d):
    m = F.col("doc_id") % 4
    rows = _t(s, d, "documents").select(F.when(m == 0, "done").when(m == 1, "pending").when(m == 2, "in_progress").otherwise("error").alias("status"))
    return tables.progress(rows, FILE_STATUSES)


def _ledger(c: DataFrame) -> DataFrame:
    return c.select(F.lit(1).alias("run_id"), "file_id", "chunk_index", "last_sentence_index", F.lit(None).cast("string").alias("last_sentence_id"), "last_chunk")


def q_resume_position(s, d):
    from millrace.operators.search import cursors

    c = cursors(_ledger(chunks(files(s, d)).where("chunk_index < 3")))
    return c.select("file_id", "chunks_done", "last_sentence_index", (F.col("chunks_done") * (SIZE - OVERLAP)).alias("start_index"))


def q_pending_chunks(s, d):
    c = chunks(files(s, d)).select("file_id", "chunk_index")
    return c.join(c.where("chunk_index < 3"), ["file_id", "chunk_index"], "left_anti")


def q_work_limit(s, d):
    f = select_files(files(s, d).drop("year"), titles(s, d), Select(languages=("en", "fr", "de", "es")))
    return f.select("file_id", "rel_path").orderBy("rel_path").limit(25)


def q_invalidate(s, d):
    gone = _t(s, d, "documents").where("doc_id % 7 = 0").select(F.col("doc_id").alias("file_id"))
    return chunks(files(s, d)).select("file_id", "chunk_index").join(gone, "file_id", "left_anti")


def q_version_order(s, d):
    i = _t(s, d, "documents").select(F.concat(F.lit("v"), (F.col("doc_id") % 37).cast("string")).alias("version"), F.lit("").alias("target"), F.lit("en").alias("source"))
    return text.numbered(available_versions(i, "en").select(F.col("version").alias("v")), [F.desc(text.version_key(F.col("v"))), F.desc("v")])


def q_resolve_monolingual(s, d):
    i = _t(s, d, "documents").select("doc_id", "lang", F.when(F.col("source") == "src0", "").otherwise(F.col("source")).alias("target"), F.lit("any").alias("source"))
    return monolingual(i, "any").groupBy("lang").agg(F.min("doc_id").alias("first_doc"))


def q_turn_chunks(s, d):
    # a conversation's turns are one bounded array, sorted in place
    sent = F.struct(F.col("turn").alias("idx"), F.col("turn").cast("string").alias("id"), "text")
    f = _t(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(sent)).alias("sentences"))
    c = text.chunked(f, 3, 1)
    return c.select("conv_id", "chunk_index", F.col("first_sentence_index").alias("first_turn"), F.col("last_sentence_index").alias("last_turn"), F.sha2(text.rendered(F.col("sents")), 256).alias("sha"))


FLAGSHIP = Manifest.model_validate(
    {"name": "flagship", "model": "contains", "select": {"languages": ["en", "fr"]}, "chunk": {"size": SIZE, "overlap": OVERLAP}, "prefilter": {"mode": "any", "patterns": list(WORDS)}, "prompt": {"user": "{{ chunk }}"}}
)


def _searched(s: SparkSession, d: str) -> DataFrame:
    """Selection, chunks, prefilter and the deterministic stand-in for the model."""
    c = chunks(select_files(files(s, d).drop("year"), titles(s, d), FLAGSHIP.select), FLAGSHIP.chunk.size, FLAGSHIP.chunk.overlap)
    return c.withColumn("kept", FLAGSHIP.prefilter.keeps(F.col("txt"))).withColumn("matched", F.lower("txt").contains("license"))


def q_search_flagship(s, d):
    return _searched(s, d).where("kept").select("file_id", "chunk_index", "first_sentence_index", "last_sentence_index", "matched")


def q_run_summary(s, d):
    return counters(_searched(s, d).select("file_id", F.when(F.col("kept"), "result").otherwise("skipped").alias("kind"), (F.col("kept") & F.col("matched")).alias("matched")))


def q_export_matches(s, d):
    c = chunks(files(s, d).drop("year")).where(F.lower("txt").contains("license"))
    t = titles(s, d).select("imdb_id", "primary_title")
    return c.join(t, "imdb_id", "left").select("rel_path", "chunk_index", F.coalesce("primary_title", "imdb_id").alias("title"), "txt").orderBy("rel_path", "chunk_index")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")} | {
    "prefilter_any": _prefilter("any"),
    "prefilter_all": _prefilter("all"),
    "prefilter_none": _prefilter("none"),
    "prefilter_regex": _prefilter("any", ("[0-9]{3}-[0-9]{4}",), regex=True, case_sensitive=True),
}


#: SQL fragments that the statements share: files, titles, sentences, chunks.
SQL_F = "files AS (SELECT doc_id AS file_id, printf('tt%07d', doc_id) AS imdb_id, lang AS language, 1950 + doc_id % 75 AS year, concat('corpus/raw/', lang, '/', 1950 + doc_id % 75, '/', doc_id, '/', doc_id, '.xml') AS rel_path, text FROM documents)"
SQL_T = "titles AS (SELECT printf('tt%07d', doc_id) AS imdb_id, CASE quality WHEN 1 THEN 'movie' ELSE 'tvEpisode' END AS title_type, concat('Title ', doc_id) AS primary_title, 1950 + doc_id % 75 AS start_year, toxic = 1 AS is_adult, CASE WHEN quality = 0 THEN printf('tt%07d', doc_id // 2) END AS parent_imdb_id, CASE WHEN quality = 0 THEN doc_id % 9 + 1 END AS season_number, CASE WHEN quality = 0 THEN doc_id % 24 + 1 END AS episode_number FROM labels)"
SQL_S = "s AS (SELECT file_id, rel_path, language, imdb_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\r\\n]+', ' ', 'g'))), lambda x: x <> '') AS a FROM files)"
SQL_C = "c AS (SELECT file_id, rel_path, language, imdb_id, k AS chunk_index, k*6 AS first_sentence_index, least(k*6+8, n)-1 AS last_sentence_index, array_to_string(a[k*6+1 : k*6+8], chr(10)) AS txt FROM (SELECT *, len(a) AS n, unnest(range(0, 1 + CAST(ceil(greatest(len(a)-8, 0)/6) AS BIGINT))) AS k FROM s WHERE len(a) > 0))"

SQL = r"""
normalize_id: SELECT doc_id, printf('tt%07d', doc_id) AS imdb_id FROM documents
parse_path: WITH {F} SELECT rel_path, string_split(rel_path,'/')[3] AS language, CAST(string_split(rel_path,'/')[4] AS INTEGER) AS year, printf('tt%07d', CAST(string_split(rel_path,'/')[5] AS BIGINT)) AS imdb_id, regexp_extract(rel_path,'([^/]+)[.]xml$',1) AS file_key FROM files
member_summary: SELECT count(*) FILTER (p LIKE '%.html') AS subtitle_count, count(*) FILTER (p NOT LIKE '%.html' AND regexp_extract(p,'([^/]*)$',1) NOT LIKE '%.%') AS metadata_count, count(*) FILTER (p NOT LIKE '%.html' AND regexp_extract(p,'([^/]*)$',1) LIKE '%.%') AS unexpected_count FROM (SELECT regexp_replace(url, '[?#].*$', '') AS p FROM pages)
catalog_index: WITH {F} SELECT file_id, rel_path, sha256(text) AS sha256, octet_length(encode(text)) AS size_bytes FROM files
sentences: WITH {F}, {S} SELECT file_id, i - 1 AS sentence_index, a[i] AS text FROM (SELECT file_id, a, unnest(range(1, len(a)+1)) AS i FROM s)
sentence_count: WITH {F}, {S} SELECT file_id, len(a) AS sentence_count FROM s
chunks: WITH {F}, {S}, {C} SELECT file_id, chunk_index, first_sentence_index, last_sentence_index, sha256(txt) AS txt_sha FROM c
chunk_count_80_10: WITH {F}, {S} SELECT file_id, CASE WHEN len(a)=0 THEN 0 ELSE 1 + CAST(ceil(greatest(len(a)-80,0)/70) AS BIGINT) END AS chunk_count FROM s
chunk_render_ids: WITH {F}, {S} SELECT file_id, k AS chunk_index, sha256(array_to_string(list_transform(range(k*6+1, least(k*6+8,n)+1), lambda i: concat('[', i, '] ', a[i])), chr(10))) AS sha FROM (SELECT file_id, a, len(a) AS n, unnest(range(0, 1 + CAST(ceil(greatest(len(a)-8, 0)/6) AS BIGINT))) AS k FROM s WHERE len(a) > 0)
prefilter_any: WITH {F}, {S}, {C} SELECT file_id, chunk_index FROM c WHERE contains(lower(txt),'license') OR contains(lower(txt),'ation')
prefilter_all: WITH {F}, {S}, {C} SELECT file_id, chunk_index FROM c WHERE contains(lower(txt),'license') AND contains(lower(txt),'ation')
prefilter_none: WITH {F}, {S}, {C} SELECT file_id, chunk_index FROM c WHERE NOT (contains(lower(txt),'license') OR contains(lower(txt),'ation'))
prefilter_regex: WITH {F}, {S}, {C} SELECT file_id, chunk_index FROM c WHERE regexp_matches(txt, '[0-9]{3}-[0-9]{4}')
select_files: WITH {F}, {T} SELECT file_id, rel_path FROM files JOIN titles USING (imdb_id) WHERE language IN ('en','fr') AND title_type IN ('movie') AND start_year BETWEEN 1960 AND 2000 AND NOT is_adult
select_unresolved: WITH {F}, {T} SELECT file_id FROM files WHERE NOT EXISTS (SELECT 1 FROM titles t WHERE t.imdb_id = files.imdb_id)
select_imdb_ids: WITH {F} SELECT file_id FROM files WHERE imdb_id IN (SELECT printf('tt%07d', item_id) FROM benchmark)
title_parent: WITH {T} SELECT c.imdb_id, c.primary_title, p.primary_title AS parent_title FROM titles c LEFT JOIN titles p ON c.parent_imdb_id = p.imdb_id
title_display: WITH {T} SELECT c.imdb_id, concat(CASE WHEN c.parent_imdb_id IS NOT NULL THEN concat(CASE WHEN p.primary_title IS NOT NULL THEN p.primary_title || ' ' ELSE '' END, printf('S%02dE%02d', c.season_number, c.episode_number), ' — ') ELSE '' END, c.primary_title, ' (', c.start_year, ')') AS display_name FROM titles c LEFT JOIN titles p ON c.parent_imdb_id = p.imdb_id
prompt_render: WITH {F}, {T}, {S}, {C} SELECT file_id, chunk_index, sha256(concat('Title: ', coalesce(t.primary_title, c.imdb_id), ' (', coalesce(CAST(t.start_year AS VARCHAR), ''), ')', chr(10), c.txt)) AS prompt_sha FROM c LEFT JOIN titles t USING (imdb_id)
validate_output: SELECT event_id, CAST(json_extract(props,'$.k') AS BIGINT) AS k, CAST(json_extract(props,'$.k') AS BIGINT) >= 50 AS matched FROM events WHERE json_type(props,'$.k') IN ('UBIGINT','BIGINT')
insert_ignore: SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1
upsert_coalesce: WITH old AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN sha256(text) END AS sha, 'downloaded' AS status FROM documents WHERE doc_id % 5 <> 0), new AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN sha256(text || '!') END AS sha, 'pending' AS status FROM documents WHERE doc_id % 4 <> 0) SELECT coalesce(new.doc_id, old.doc_id) AS doc_id, coalesce(new.sha, old.sha) AS sha, coalesce(new.status, old.status) AS status FROM old FULL JOIN new ON old.doc_id = new.doc_id
refresh_diff: WITH old AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 0), new AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0) SELECT coalesce(new.doc_id, old.doc_id) AS doc_id, CASE WHEN old.h IS NULL THEN 'new' WHEN new.h IS NULL THEN 'missing' ELSE 'changed' END AS change FROM old FULL JOIN new ON old.doc_id = new.doc_id WHERE old.h IS DISTINCT FROM new.h
run_progress: SELECT st.status, count(d.doc_id) AS files FROM (VALUES ('pending'),('in_progress'),('done'),('skipped'),('error')) st(status) LEFT JOIN (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'pending' WHEN 2 THEN 'in_progress' ELSE 'error' END AS status FROM documents) d USING (status) GROUP BY st.status
resume_position: WITH {F}, {S}, {C} SELECT file_id, count(*) AS chunks_done, max(last_sentence_index) AS last_sentence_index, count(*)*6 AS start_index FROM c WHERE chunk_index < 3 GROUP BY file_id
pending_chunks: WITH {F}, {S}, {C} SELECT file_id, chunk_index FROM c ANTI JOIN (SELECT file_id, chunk_index FROM c WHERE chunk_index < 3) d USING (file_id, chunk_index)
work_limit: WITH {F}, {T} SELECT file_id, rel_path FROM files JOIN titles USING (imdb_id) WHERE NOT is_adult ORDER BY rel_path LIMIT 25
invalidate: WITH {F}, {S}, {C} SELECT file_id, chunk_index FROM c WHERE file_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 7 = 0)
version_order: SELECT v, row_number() OVER (ORDER BY CAST(regexp_extract(v,'[0-9]+') AS BIGINT) DESC, v DESC) AS rank FROM (SELECT DISTINCT concat('v', doc_id % 37) AS v FROM documents)
resolve_monolingual: SELECT lang, min(doc_id) AS first_doc FROM documents WHERE source = 'src0' GROUP BY lang
turn_chunks: SELECT conv_id, k AS chunk_index, k*2 AS first_turn, least(k*2+3, n)-1 AS last_turn, sha256(array_to_string(a[k*2+1:k*2+3], chr(10))) AS sha FROM (SELECT conv_id, a, len(a) AS n, unnest(range(0, 1 + CAST(ceil(greatest(len(a)-3,0)/2) AS BIGINT))) AS k FROM (SELECT conv_id, list(concat('[', turn, '] ', text) ORDER BY turn) AS a FROM conversations GROUP BY conv_id))
search_flagship: WITH {F}, {T}, {S}, {C} SELECT file_id, chunk_index, first_sentence_index, last_sentence_index, contains(lower(txt),'license') AS matched FROM c JOIN titles USING (imdb_id) WHERE language IN ('en','fr') AND NOT is_adult AND (contains(lower(txt),'license') OR contains(lower(txt),'ation'))
run_summary: WITH {F}, {T}, {S}, {C}, w AS (SELECT c.*, contains(lower(txt),'license') AS m, contains(lower(txt),'license') OR contains(lower(txt),'ation') AS kept FROM c JOIN titles USING (imdb_id) WHERE language IN ('en','fr') AND NOT is_adult) SELECT count(DISTINCT file_id) AS files_done, count(*) AS chunks_done, count(*) FILTER (NOT kept) AS chunks_skipped, count(*) FILTER (kept AND m) AS matches FROM w
export_matches: WITH {F}, {T}, {S}, {C} SELECT rel_path, chunk_index, coalesce(t.primary_title, c.imdb_id) AS title, txt FROM c LEFT JOIN titles t USING (imdb_id) WHERE contains(lower(txt),'license') ORDER BY rel_path, chunk_index
"""


def oracles() -> dict[str, str]:
    out = {}
    for line in SQL.strip().splitlines():
        name, sql = line.split(": ", 1)
        for mark, part in (("{F}", SQL_F), ("{T}", SQL_T), ("{S}", SQL_S), ("{C}", SQL_C)):
            sql = sql.replace(mark, part)
        out[name] = sql
    return out
