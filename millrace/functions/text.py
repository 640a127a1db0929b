"""Column functions of the search engine: ids, paths, sentences, chunks, rendering, prompts.  All stay in the JVM,
except reading XML, which is an Arrow UDF."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import ManifestError


def title_id(raw: Column) -> Column:
    """'tt' and the number, padded to seven digits; null for what isn't an id."""
    digits = F.regexp_replace(F.regexp_extract(raw, r"^(?:tt)?(\d+)$", 1), r"^0+(?=\d)", "")
    padded = F.concat(F.lit("tt"), F.repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(7) - F.length(digits))), digits)
    return F.when(raw.rlike(r"^(?:tt)?\d+$"), padded)


def parsed_path(path: Column) -> Column:
    """struct(corpus, preprocessing, language, year, imdb_id, subtitle_id) of corpus/prep/language/year/id/file.xml, or null."""
    p = F.split(path, "/")
    at = lambda i: F.get(p, F.lit(i))
    year = F.when(at(3).rlike(r"^\d{4}$"), at(3).try_cast("int"))
    entry = F.struct(
        at(0).alias("corpus"), at(1).alias("preprocessing"), at(2).alias("language"), F.when(year.between(1850, 2100), year).alias("year"),
        title_id(at(4)).alias("imdb_id"), F.regexp_extract(at(5), r"^(.+)[.]xml$", 1).alias("subtitle_id"),
    )
    return F.when((F.size(p) == 6) & at(5).rlike(r"^.+[.]xml$") & title_id(at(4)).isNotNull(), entry)


def text_sentences(text: Column) -> Column:
    """The plain-text adapter: trimmed lines with white space collapsed, empty ones left out."""
    return F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.btrim(F.regexp_replace(x, "[ \t\r\n]+", " "))), lambda x: x != "")


#: Bytes of documents whose sentences are passed on together, or one document.
RUN_BYTES = 1 << 20
SENTENCES = pa.list_(pa.struct([("idx", pa.int64()), ("id", pa.string()), ("text", pa.string()), ("start", pa.string()), ("end", pa.string())]))
COMMENT, CDATA = re.compile(r"<!--.*?(?:-->|\Z)", re.S), re.compile(r"<!\[CDATA\[(.*?)\]\]>", re.S)
_W = r"[ \t\n\x0b\f\r]"
OPENED, CLOSED, EMPTY, TAG = re.compile(r"<s[ \t\n\x0b\f\r/>]"), re.compile(rf"</s{_W}*>"), re.compile(rf"<s(?:{_W}[^>]*)?/>"), re.compile(r"<[^>]*>?")
OWN_ID = re.compile(rf"""<s\b[^>]*?\bid{_W}*={_W}*["']([^"']*)["']""")
STARTS, ENDS = (re.compile(rf"""<time\b[^>]*?\bid{_W}*={_W}*["'][^"']*{side}["'][^>]*?\bvalue{_W}*={_W}*["']([^"']*)["']""") for side in "SE")


def read_xml(xml: str) -> tuple[list[str], list[str], list[str | None], list[str | None]]:
    """Ids, texts, starts and ends of the sentences of a subtitle document; tolerant of markup that never closes.

    Every s element counts, empty ones too.  Comments go first, since they may quote markup.  start is the first start
    marker inside the sentence, else the last one before; end is the last end marker inside, else the next one after.
    Time strings are opaque.
    """
    clean = CDATA.sub(r"\1", COMMENT.sub("", xml)) if "<!" in xml else xml
    edges = [m.start() for m in OPENED.finditer(clean)]
    ids, texts, starts, ends, held = [], [], [], [], None
    firsts: list[str | None] = []
    for i, k in zip(edges, [*edges, len(clean)][1:], strict=True):
        part = clean[i:k]
        own = OWN_ID.match(part)
        ids.append(own[1] if own else "")
        if EMPTY.match(part):
            body = ""
        else:
            stop = CLOSED.search(part)
            body = TAG.sub("", part[: stop.start()] if stop else part)
        texts.append(" ".join((html.unescape(body) if "&" in body else body).split()))
        timed = "<time" in part
        s, e = (STARTS.findall(part), ENDS.findall(part)) if timed else ((), ())
        starts.append(s[0] if s else held)
        held = s[-1] if s else held
        firsts.append(e[0] if e else None)
        ends.append(e[-1] if e else None)
    held = None
    for i in range(len(ends) - 1, -1, -1):
        ends[i] = held if ends[i] is None else ends[i]
        held = held if firsts[i] is None else firsts[i]
    return ids, texts, starts, ends


def sentence_lists(xml: pa.Array) -> Iterator[pa.Array]:
    """The sentences of documents, in slices of about RUN_BYTES bytes; null for null."""
    offsets, rows, held = [0], ([], [], [], [], []), 0

    def given() -> pa.Array:
        cols = [pa.array(c, t.type) for c, t in zip(rows, SENTENCES.value_type, strict=True)]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(cols, fields=list(SENTENCES.value_type)))

    for x in xml:
        if x.is_valid:
            raw = x.as_py()
            got = read_xml(raw.decode("utf-8", "replace"))
            for c, more in zip(rows, (range(len(got[0])), *got), strict=True):
                c.extend(more)
            held += len(raw)
        else:
            offsets[-1] = None  # a null list begins where the next one does
        offsets.append(len(rows[0]))
        if held >= RUN_BYTES:
            yield given()
            offsets, rows, held = [0], ([], [], [], [], []), 0
    if len(offsets) > 1:
        yield given()


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("idx", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("id", "text", "start", "end")]])))
def xml_sentences(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """array<struct<idx, id, text, start, end>> of subtitle documents as bytes, as read_xml has them."""
    for b in batches:
        yield from sentence_lists(b)


#: Said to be nondeterministic, so that no filter or second use reads a document again.
xml_sentences = xml_sentences.asNondeterministic()


def with_sentences(files: DataFrame, xml: str = "content") -> DataFrame:
    """files with sentences: array<struct<idx, id, text, start, end>> read from an XML column (binary or string); null for null."""
    return files.withColumn("sentences", xml_sentences(F.col(xml).cast("binary")))


def plain_sentences(files: DataFrame, text: str = "text") -> DataFrame:
    """files with sentences from plain text: ids are the numbers from 1."""
    lines = F.transform(text_sentences(F.col(text)), lambda x, i: F.struct(i.cast("long").alias("idx"), (i + 1).cast("string").alias("id"), x.alias("text"), F.lit(None).cast("string").alias("start"), F.lit(None).cast("string").alias("end")))
    return files.withColumn("sentences", lines)


def exploded(files: DataFrame, start: int = 0) -> DataFrame:
    """A row per sentence from index start on."""
    return files.withColumn("s", F.explode("sentences")).where(F.col("s.idx") >= start)


def check_window(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("the chunk size must be at least 1")
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be at least 0 and below the size")


def chunk_count(n: Column, size: int, overlap: int) -> Column:
    """Chunks of n sentences: none for none, and none that lies whole in the one before."""
    check_window(size, overlap)
    return F.when(n <= 0, F.lit(0)).otherwise(1 + F.ceil(F.greatest(n - size, F.lit(0)) / F.lit(float(size - overlap)))).cast("long")


def chunked(files: DataFrame, size: int, overlap: int, first: int = 0, outer: bool = False) -> DataFrame:
    """A row per chunk: chunk_index, sents, first and last sentence index, last_chunk.  No shuffle: a file's sentences are an
    array, of which each chunk's row holds its own part alone.  With outer, a file without chunks has one row of nulls, in
    which no_text tells whether it lacks its sentences altogether."""
    check_window(size, overlap)
    step = size - overlap
    n = F.size("sentences").cast("long")
    own = lambda k: F.struct(
        k.alias("chunk_index"), F.slice("sentences", (k * step + 1).cast("int"), F.lit(size)).alias("sents"), (k * step).alias("first_sentence_index"),
        (F.least(k * step + size, n) - 1).alias("last_sentence_index"), (k == F.col("_n") - 1).alias("last_chunk"),
    )
    d = files.withColumn("_n", chunk_count(n, size, overlap))
    windows = F.when(F.col("_n") > first, F.transform(F.sequence(F.lit(first).cast("long"), F.col("_n") - 1), own))
    kept = [c for c in files.columns if c != "sentences"]
    if outer:
        return d.select(*kept, F.col("sentences").isNull().alias("no_text"), F.inline_outer(windows))
    return d.where(F.col("_n") > first).select(*kept, F.inline(windows))


def rendered(sents: Column, with_ids: bool = True) -> Column:
    line = (lambda s: F.concat(F.lit("["), s["id"], F.lit("] "), s["text"])) if with_ids else (lambda s: s["text"])
    return F.array_join(F.transform(sents, line), "\n")


def display_name(prefix: str = "") -> Column:
    """'Series S01E02 — Title (year)' or 'Title (year)'; unknown parts are left out."""
    c = lambda n: F.col(f"{prefix}{n}")
    number = F.when(c("season_number").isNotNull() & c("episode_number").isNotNull(), F.format_string("S%02dE%02d", c("season_number"), c("episode_number")))
    lead = F.nullif(F.concat_ws(" ", c("parent_title"), number), F.lit(""))
    name = F.concat_ws(" ", F.coalesce(c("primary_title"), c("original_title")), F.when(c("start_year").isNotNull(), F.concat(F.lit("("), c("start_year").cast("string"), F.lit(")"))))
    return F.concat_ws(" — ", F.when(c("parent_imdb_id").isNotNull(), lead), name)


PLACEHOLDER = re.compile(r"\{\{\s*(\w+)\s*\}\}")
#: Names that a prompt may mention.
PLACEHOLDERS = ("title", "imdb_id", "year", "season", "episode", "chunk")


def prompt(template: str, values: dict[str, Column]) -> Column:
    """The template with its placeholders replaced, in a single pass; values are inserted as they are, null as nothing."""
    parts, at = [], 0
    for m in PLACEHOLDER.finditer(template):
        if m[1] not in values:
            raise ManifestError(f"unknown placeholder {m[1]!r}; known: {', '.join(sorted(values))}")
        parts += [F.lit(template[at : m.start()]), F.coalesce(values[m[1]].cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def prefilter(text: Column, mode: str, patterns: tuple[str, ...], case_sensitive: bool = False, regex: bool = False) -> Column:
    """Whether the text passes: any, all or none of the patterns found; off passes all."""
    if mode == "off":
        return F.lit(True)
    if not patterns:
        raise ManifestError("an active prefilter needs a pattern")
    if regex:
        for p in patterns:
            try:
                re.compile(p)
            except re.error as e:
                raise ManifestError(f"the pattern {p!r} isn't a regular expression: {e}") from e
            if re.search(r"\(\?P[<=>]|\(\?\(", p):
                raise ManifestError(f"the pattern {p!r} uses a construct that the engine lacks")
        hits = [text.rlike(p if case_sensitive else f"(?iu){p}") for p in patterns]
    elif case_sensitive:
        hits = [text.contains(p) for p in patterns]
    else:
        hits = [F.lower(text).contains(F.lower(F.lit(p))) for p in patterns]
    if mode == "all":
        return reduce(lambda a, b: a & b, hits)
    found = reduce(lambda a, b: a | b, hits)
    return ~found if mode == "none" else found


def version_key(version: Column) -> Column:
    """An array that orders releases by their numbers; releases without numbers come lowest."""
    parts = F.split(F.regexp_replace(version, "^v", ""), "[.]")
    return F.when(F.forall(parts, lambda p: p.rlike("^[0-9]+$")), F.transform(parts, lambda p: p.try_cast("bigint"))).otherwise(F.expr("cast(array() as array<bigint>)"))


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
