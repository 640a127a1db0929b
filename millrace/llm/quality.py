"""Quality rules whose cutoffs carry a guarantee (native: DataFrame functions only).

A rule rejects a document when a feature exceeds a cutoff.  Cutoffs come from a fixed grid, so they do not depend on
the labels, and all labelled documents serve as the holdout.  For each stratum, feature and cutoff the hypothesis "this
rule rejects more than alpha of the good documents" is tested with the exact binomial tail P(X <= k), X ~ Bin(n, alpha),
n good documents of the stratum and k of them rejected.  A cutoff is certified when that tail is at most delta / tests
(Bonferroni over every stratum, feature and cutoff), so with probability 1 - delta all certified rules hold at once and
a document meets false_rejection = features * alpha at most.  Among the certified cutoffs of a stratum and feature the
one wins that rejects most bad documents, each rejected good one weighing PENALTY bad ones; ties go to the loosest.

Cases: a null text has no words; a null stratum is the stratum 'und'; strata without enough labels get no rule; labels
given twice count once, contradictory or null ones not at all; empty tables give empty results.  Columns of the input
other than doc_id, text and the stratum are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import cut, table, words

#: Shares in thousandths.  Fixed grid, the same at every size.
GRID = (20, 40, 60, 80, 100, 150, 200, 250, 300, 400, 500, 700)
FEATURES = ("symbols", "capitals", "dup_lines", "repeats")
FALSE_REJECTION, DELTA, PENALTY = 0.05, 0.05, 5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Cutoffs of up to so many strata are broadcast; more are joined by a shuffle.
MOST_BROADCAST_STRATA = 10_000
#: Up to so many repeated windows are looked for one by one, more by sorting; either way finds all.
FEW = 24


def measures(df: DataFrame, text: Column) -> DataFrame:
    """Adds a struct column _m with the counts of each text; every step stays in the JVM."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_w", words(t)).withColumn("_l", lines)
    df = df.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    window = "transform(sequence(0, size(_h) - 3), i -> xxhash64(_h[i], _h[i + 1], _h[i + 2]))"
    df = df.withColumn("_k", F.expr(f"case when size(_h) < 3 then cast(array() as array<bigint>) else {window} end"))
    # most texts repeat no window; only for the others the windows are sorted, and repeated ones found as neighbours
    df = df.withColumn("_q", F.expr("case when size(array_distinct(_k)) < size(_k) then sort_array(_k) else cast(array() as array<bigint>) end"))
    df = df.withColumn("_u", F.expr("case when size(_q) = 0 then cast(array() as array<bigint>) else array_distinct(transform(filter(sequence(1, size(_q) - 1), j -> _q[j] = _q[j - 1]), j -> _q[j])) end"))
    few = "filter(sequence(0, size(_k) - 1), i -> array_contains(_u, _k[i]))"
    df = df.withColumn("_s", F.expr(f"case when size(_u) > {FEW} then sort_array(transform(_k, (h, i) -> struct(h as h, i as i))) else cast(array() as array<struct<h: bigint, i: int>>) end"))
    many = (
        "transform(filter(sequence(0, size(_s) - 1), j -> (j > 0 and _s[greatest(j - 1, 0)].h = _s[j].h) "
        "or (j < size(_s) - 1 and _s[least(j + 1, size(_s) - 1)].h = _s[j].h)), j -> _s[j].i)"
    )
    df = df.withColumn("_p", F.expr(f"case when size(_u) = 0 then cast(array() as array<int>) when size(_u) <= {FEW} then {few} else {many} end"))
    df = df.withColumn("_r", F.expr("size(array_distinct(flatten(transform(_p, i -> array(i, i + 1, i + 2)))))"))
    return df.withColumn(
        "_m",
        F.struct(
            F.size("_w").cast("long").alias("n_words"),
            F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
            F.col("_r").cast("long").alias("n_repeat_words"),
            F.size("_l").cast("long").alias("n_lines"),
            F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        ),
    ).drop("_w", "_l", "_h", "_k", "_q", "_u", "_s", "_p", "_r")


def feature_values(m: str = "_m") -> dict[str, Column]:
    """Whole thousandths, so that every engine compares the same integers."""
    share = lambda part, whole: F.expr(f"coalesce((1000 * {m}.{part}) div nullif({m}.{whole}, 0), 0L)")
    return {
        "symbols": share("n_symbols", "word_chars"),
        "capitals": share("n_capitals", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
    }


def base_failed(m: str = "_m") -> Column:
    return F.expr(f"{m}.n_words < {MIN_WORDS} or 100 * {m}.n_repeat_words > {MAX_REPEAT_PERCENT} * {m}.n_words")


def scores(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Narrow rows: doc_id, stratum, the measures, the features and base_failed."""
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("und")).alias("stratum"), F.col("text").cast("string").alias("text")
    )
    m = measures(own, F.col("text"))
    return m.select("doc_id", "stratum", "_m", base_failed().alias("base_failed"), *[v.alias(f"f_{k}") for k, v in feature_values().items()])


def binomial_tail(n: str, k: str, a: float) -> Column:
    """P(X <= k), X ~ Bin(n, a), summed exactly from the logarithms of successive terms; 1 where k >= n * a."""
    step = f"t + ln(({n} - i + 1) * {a!r}D / (i * (1 - {a!r}D)))"
    one = f"named_struct('t', {n} * ln(1 - {a!r}D), 's', exp({n} * ln(1 - {a!r}D)))"
    grow = f"(acc, i) -> named_struct('t', acc.{step}, 's', acc.s + exp(acc.{step}))"
    return F.expr(f"case when {k} >= {n} * {a!r}D then 1D when {k} = 0 then exp({n} * ln(1 - {a!r}D)) else aggregate(sequence(1, cast({k} as int)), {one}, {grow}, acc -> acc.s) end")


def cutoffs(scored: DataFrame, labels: DataFrame, false_rejection: float = FALSE_REJECTION, delta: float = DELTA) -> DataFrame:
    """(stratum, c_<feature>...): one row per stratum with labels; null where no cutoff is certified."""
    alpha = false_rejection / len(FEATURES)
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("q"))
        .where("doc_id is not null and q is not null")
        .groupBy("doc_id")
        .agg(F.min("q").alias("q"), F.max("q").alias("_q"))
        .where("q = _q")
    )
    held = scored.where("not base_failed").join(marks, "doc_id")
    good, bad = F.col("q") == 1, F.col("q") == 0
    over = lambda f, c: F.col(f"f_{f}") > c
    counts = [F.count_if((who) & over(f, c)).alias(f"{w}_{f}_{c}") for f in FEATURES for c in GRID for w, who in (("k", good), ("b", bad))]
    tally = held.groupBy("stratum").agg(F.count_if(good).alias("n"), *counts)
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(c).alias("cutoff"), F.col(f"k_{f}_{c}").alias("k"), F.col(f"b_{f}_{c}").alias("b")) for f in FEATURES for c in GRID])
    strata = tally.agg(F.count("*").alias("strata"))
    rows = tally.crossJoin(F.broadcast(strata)).select("stratum", "n", "strata", F.inline(cells))  # strata: one row
    tested = rows.withColumn("p", binomial_tail("n", "k", alpha)).where(F.col("p") <= delta / (F.col("strata") * len(FEATURES) * len(GRID)))
    best = tested.where(f"b > {PENALTY} * k").groupBy("stratum").agg(
        *[F.max(F.when(F.col("feature") == f, F.struct((F.col("b") - PENALTY * F.col("k")).alias("gain"), F.col("cutoff").alias("c"))))["c"].alias(f"c_{f}") for f in FEATURES]
    )
    return best


def judged(scored: DataFrame, cuts: DataFrame) -> DataFrame:
    """scored plus kept; the side of the cutoffs has a row per stratum, and AQE broadcasts it if its measured size allows."""
    hits = [F.coalesce(F.col(f"f_{f}") > F.col(f"c_{f}"), F.lit(False)) for f in FEATURES]
    return scored.join(cuts, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~reduce(lambda a, b: a | b, hits))


def filter_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **how: float) -> DataFrame:
    """The documents that pass, with their own columns.  Cutoffs come from the labelled rows alone; the texts are then
    measured where they lie, without shuffling them."""
    marked = docs.select("doc_id", "text", stratum).join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    cuts = cut(cutoffs(cut(scores(marked, stratum)), labels, **how).select(F.col("stratum").alias("_stratum"), *[F.col(f"c_{f}").alias(f"_c_{f}") for f in FEATURES]))
    m = measures(docs.withColumn("_stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("und"))), F.col("text").cast("string"))
    value = feature_values()
    hits = [F.coalesce(value[f] > F.col(f"_c_{f}"), F.lit(False)) for f in FEATURES]
    side = F.broadcast(cuts) if cuts.count() <= MOST_BROADCAST_STRATA else cuts
    # one condition over both sides: Spark would push a part of it below and there expand the measures once per mention
    kept = F.when(base_failed(), F.lit(False)).otherwise(~reduce(lambda a, b: a | b, hits))
    return m.join(side, "_stratum", "left").where(kept).select(*[m[c] for c in docs.columns])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = cut(scores(table(spark, sf_dir, "documents")))
    cuts = cut(cutoffs(scored, table(spark, sf_dir, "labels")))
    m = "n_words word_chars n_symbols n_dup_lines n_repeat_words".split()
    return judged(scored, cuts).select("doc_id", *[F.col(f"_m.{c}").alias(c) for c in m], "base_failed", "kept")


def oracle() -> str:
    alpha = FALSE_REJECTION / len(FEATURES)
    grid = ", ".join(f"({c})" for c in GRID)
    feats = " UNION ALL ".join(f"SELECT doc_id, stratum, q, '{f}' AS feature, f_{f} AS v FROM held" for f in FEATURES)
    tests = f"(SELECT count(*) FROM (SELECT DISTINCT stratum FROM held)) * {len(FEATURES) * len(GRID)}"
    hit = " OR ".join(f"coalesce(f_{f} > c_{f}, false)" for f in FEATURES)
    share = lambda a, b: f"coalesce((1000 * {a}) // nullif({b}, 0), 0)"
    W, B = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
    return f"""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{W}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{W}')) AS l, row_number() OVER () AS rid FROM documents),
tri AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
dup AS (SELECT rid, i FROM tri QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY rid),
m AS (SELECT doc_id, stratum, len(w) AS n_words, CAST(length(regexp_replace(t, '{B}', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS n_capitals FROM d LEFT JOIN rep USING (rid)),
f AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed, {share("n_symbols", "word_chars")} AS f_symbols, {share("n_capitals", "word_chars")} AS f_capitals, {share("n_dup_lines", "n_lines")} AS f_dup_lines, {share("n_repeat_words", "n_words")} AS f_repeats FROM m),
held AS (SELECT f.*, q FROM f JOIN (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = max(quality)) USING (doc_id) WHERE NOT base_failed),
cells AS (SELECT stratum, feature, g.c AS cutoff, count(*) FILTER (q = 1) AS n, count(*) FILTER (q = 1 AND v > g.c) AS k, count(*) FILTER (q = 0 AND v > g.c) AS b FROM ({feats}) CROSS JOIN (VALUES {grid}) AS g(c) GROUP BY ALL),
pv AS (SELECT *, CASE WHEN k >= n * {alpha!r} THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha!r}) + (n - i) * ln(1 - {alpha!r}))) FROM range(0, k + 1) r(i)) END AS p FROM cells),
best AS (SELECT stratum, feature, max_by(cutoff, (b - {PENALTY} * k) * 10000 + cutoff) AS c FROM pv WHERE p <= {DELTA!r} / ({tests}) AND b > {PENALTY} * k GROUP BY stratum, feature),
cuts AS (SELECT stratum, {", ".join(f"max(c) FILTER (feature = '{f}') AS c_{f}" for f in FEATURES)} FROM best GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({hit}) AS kept FROM f LEFT JOIN cuts USING (stratum)
"""
