"""Mixing sources to target weights by a low-discrepancy schedule (native: DataFrame functions only).

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating; each gets its share of all words, at most
MAX_TAKES times its own size, and what is above is reshared by weight (water filling, solved in one pass over the
sources in order of cap / weight).

Schedule: each source's documents, in the order of a keyed md5, form one stretch of words that is cut into blocks of
equal word counts (block i of a source ends at floor((i + 1) * size / blocks)).  Slot k of the mix takes the golden
ratio point frac((k + 0.5) * phi); the cumulative weights of the sources map it to a source, and the slot's rank r
among that source's slots to block r mod blocks.  The number of slots follows TARGET_SLOTS and the number of sources,
not the size of the corpus.  A document is taken as often as the slots take the words it holds; a block edge may
divide a document.  Everything depends on the rows alone, so reruns agree.

Cases: a null text has size 0 and is taken 0 words, as is any document without a word; a null source is a source of
its own; equal rows are separate documents; empty tables give empty results; no column but doc_id, source and text is
read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, table, words

WEIGHTS = (5, 2, 1)
MAX_TAKES = 3
TARGET_SLOTS = 1 << 15
#: Every source has at least so many blocks (or one per word), so that small sources meet their targets closely.
MIN_BLOCKS = 512
PHI = 0.6180339887498949
SEED = "mix-1"
GRID = 4096


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, key (the source as a string that sorts nulls last), hash (place in the shuffled order), size in words."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string"))).alias("key"),
        F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("hash"),
        F.size(words(F.col("text").cast("string"))).cast("long").alias("size"),
    )


def targets(sizes: DataFrame) -> DataFrame:
    """(key, source_size, weight, target, blocks, slots): one row per source; windows run over sources, not documents."""
    s = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    by_key, ratio = Window.orderBy("key"), Window.orderBy("ratio", "key")
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_key) - 1) % len(WEIGHTS) + 1).cast("int"))
    s = s.withColumn("weight", w.cast("double")).withColumn("cap", (F.col("source_size") * MAX_TAKES).cast("double")).withColumn("ratio", F.expr("cap / weight"))
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    s = s.withColumn("lam", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("target", F.least("cap", F.col("weight") * F.max("lam").over(every)))
    total = F.sum("source_size").over(every)
    s = s.withColumn("blocks", F.least(F.col("source_size"), F.greatest(F.ceil(F.expr(f"source_size * {TARGET_SLOTS}D") / F.greatest(total, F.lit(1))), F.lit(MIN_BLOCKS))).cast("long"))
    return s.withColumn("slots", F.expr("case when blocks = 0 then 0D else target * blocks / source_size end")).select("key", "source_size", "weight", "target", "blocks", "slots")


def schedule(sources: DataFrame) -> DataFrame:
    """(slot, key, rank, block): which block of which source each slot of the mix takes.

    The cumulative weights are met through a grid of equal cells: an interval lies in the cells that it touches, so the
    join is by equality of cells and no slot is compared with every source.
    """
    by_key = Window.orderBy("key")
    end = F.sum("slots").over(by_key)
    all_slots = F.sum("slots").over(Window.partitionBy(F.lit(1)))
    s = sources.where("slots > 0").withColumn("hi", end / all_slots).withColumn("lo", (end - F.col("slots")) / all_slots).withColumn("n", F.round(all_slots).cast("long"))
    cells = s.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * GRID).cast("int"), F.floor(F.least(F.col("hi"), F.lit(1.0)) * GRID).cast("int"))))
    slots = s.groupBy().agg(F.max("n").alias("n")).where("n > 0").select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slot"))
    slots = slots.withColumn("u", F.expr(f"(slot + 0.5D) * {PHI}D - floor((slot + 0.5D) * {PHI}D)")).withColumn("cell", F.floor(F.col("u") * GRID).cast("int"))
    last = F.max("key").over(Window.partitionBy(F.lit(1)))
    cells = cells.withColumn("hi", F.when(F.col("key") == last, F.lit(2.0)).otherwise(F.col("hi")))
    hit = slots.join(cells, "cell").where("u >= lo and u < hi")
    ranked = hit.withColumn("rank", (F.row_number().over(Window.partitionBy("key").orderBy("slot")) - 1).cast("long"))
    return ranked.where(F.col("rank") < F.col("blocks") * MAX_TAKES).select("slot", "key", "rank", (F.col("rank") % F.col("blocks")).alias("block"))


def spread(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds off, the place of each document's first word in its source's shuffled stretch: sums over 4096 buckets of the
    shuffled order per source, then within a bucket, so a source that holds most rows is still dealt over many tasks."""
    b = sizes.withColumn("bucket", F.substring("hash", 1, 3))
    per = b.groupBy("key", "bucket").agg(F.sum("size").alias("sum"))
    w = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("base", F.coalesce(F.sum("sum").over(w), F.lit(0))).drop("sum")
    per = per.join(sources, "key")
    own = Window.partitionBy("key", "bucket").orderBy("hash", "doc_id", "size")
    d = b.join(per, ["key", "bucket"]).withColumn("row", F.row_number().over(own))
    return d.withColumn("off", F.col("base") + F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))


def spans(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mix: (doc_id, key, row, bucket, size, source_size, target, start, stop, takes), a row for each stretch of
    words [start, stop) of a document that lies in one block, with the number of slots that take it; and the schedule."""
    sources = cut(targets(sizes))
    plan = cut(schedule(sources))
    takes = plan.groupBy("key", "block").agg(F.count("*").alias("takes"))
    d = spread(sizes, sources)
    # the block of a word at place p is the least i with floor((i + 1) * size / blocks) > p
    at = lambda p: f"cast(case when floor((floor(({p}) * cast(blocks as decimal(38, 0)) / source_size) + 1) * source_size / blocks) > ({p}) then floor(({p}) * cast(blocks as decimal(38, 0)) / source_size) else floor(({p}) * cast(blocks as decimal(38, 0)) / source_size) + 1 end as bigint)"
    d = d.withColumn("block", F.expr(f"explode_outer(case when size > 0 then sequence({at('off')}, {at('off + size - 1')}) end)"))
    d = d.withColumn("start", F.expr("greatest(cast(floor(cast(block as decimal(20, 0)) * source_size / blocks) as bigint) - off, 0L)"))
    d = d.withColumn("stop", F.expr("least(cast(floor(cast(block + 1 as decimal(20, 0)) * source_size / blocks) as bigint) - off, size)"))
    return d.join(takes, ["key", "block"], "left").withColumn("takes", F.coalesce("takes", F.lit(0))), plan


def mix(sizes: DataFrame) -> DataFrame:
    """doc_id, key, row, bucket, size, source_size, target, taken: a row per document."""
    s, _ = spans(sizes)
    return s.groupBy("key", "bucket", "row", "hash", "doc_id", "size", "source_size", "target").agg(F.coalesce(F.sum(F.expr("(stop - start) * takes")), F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix with their own columns, each as often as its taken words come to its size.  A fraction is rounded up
    with its own probability, by the document's hash, so the words of a source come near its target as the parts would."""
    chance = F.expr("conv(substring(hash, 20, 12), 16, 10) / 281474976710656D")
    took = mix(cut(sized(docs))).where("size > 0").withColumn("_copies", F.floor(F.col("taken") / F.col("size") + chance).cast("int")).where("_copies > 0")
    # equal ids share one row of counts: the rows of an id are told apart by size and by their place among equals
    own = docs.withColumn("_size", F.size(words(F.col("text").cast("string"))).cast("long")).withColumn("_key", F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string"))))
    w = Window.partitionBy("key", "doc_id", "size").orderBy("row")
    took = took.withColumn("_n", F.row_number().over(w)).select(F.col("key").alias("_k"), F.col("doc_id").alias("_id"), F.col("size").alias("_s"), "_n", "_copies")
    own = own.withColumn("_n", F.row_number().over(Window.partitionBy("_key", "doc_id", "_size").orderBy(F.xxhash64("text"))))
    hit = own.join(took, (own["_key"] == took["_k"]) & own["doc_id"].cast("long").eqNullSafe(took["_id"]) & (own["_size"] == took["_s"]) & (own["_n"] == took["_n"]))
    return hit.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*[own[c] for c in docs.columns])


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(cut(sized(table(spark, sf_dir, "documents")))).select("doc_id", "size", "source_size", "target", "taken")


def oracle() -> str:
    w = ", ".join(map(str, WEIGHTS))
    return f"""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS hash, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size, CAST(([{w}])[(row_number() OVER (ORDER BY key) - 1) % {len(WEIGHTS)} + 1] AS DOUBLE) AS weight FROM d GROUP BY key),
s1 AS (SELECT *, {MAX_TAKES}.0::DOUBLE * source_size AS cap, ({MAX_TAKES}.0::DOUBLE * source_size) / weight AS ratio FROM s0),
s2 AS (SELECT *, ((sum(source_size) OVER ()) - coalesce(sum(cap) OVER b, 0.0)) / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER b, 0.0)) AS lam FROM s1 WINDOW b AS (ORDER BY ratio, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT key, source_size, least(cap, weight * max(lam) OVER ()) AS target, CAST(least(source_size, greatest(ceil(source_size * {TARGET_SLOTS}.0::DOUBLE / greatest(sum(source_size) OVER (), 1)), {MIN_BLOCKS})) AS BIGINT) AS blocks FROM s2),
s4 AS (SELECT *, CASE WHEN blocks = 0 THEN 0.0 ELSE target * blocks / source_size END AS slots FROM s3),
s5 AS (SELECT key, (sum(slots) OVER (ORDER BY key)) / (sum(slots) OVER ()) AS hi, ((sum(slots) OVER (ORDER BY key)) - slots) / (sum(slots) OVER ()) AS lo, round(sum(slots) OVER ()) AS n, key = max(key) OVER () AS last FROM s4 WHERE slots > 0),
k AS (SELECT i AS slot, (i + 0.5::DOUBLE) * {PHI}::DOUBLE - floor((i + 0.5::DOUBLE) * {PHI}::DOUBLE) AS u FROM range(0, CAST((SELECT max(n) FROM s5) AS BIGINT)) r(i)),
taken AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY slot) - 1 AS rank FROM k JOIN s5 ON u >= lo AND (u < hi OR last)),
n AS (SELECT key, least(count(*), max(blocks) * {MAX_TAKES}) AS n, max(blocks) AS blocks FROM taken JOIN s4 USING (key) GROUP BY key),
o AS (SELECT *, CAST(sum(size) OVER (PARTITION BY key ORDER BY hash, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS off FROM d)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE (coalesce(n.n, 0) // s4.blocks) * size + greatest(0, least(off + size, ((coalesce(n.n, 0) % s4.blocks) * source_size) // s4.blocks) - off) END AS BIGINT) AS taken
FROM o JOIN s4 USING (key) LEFT JOIN n USING (key)
"""
