"""Embedding near-duplicates by lattice hashing.

Each of TABLES tables projects the unit vectors to blocks of 8 dimensions at random, scales them, and decodes every
block to its nearest point of the E8 lattice; the points are the vector's cell.  A vector is entered in its own cell and
probes the cells that come next nearest: in one block at a time, the other coset's nearest point and two neighbours across the
nearest walls.  Two vectors of one label meet where one's own cell is among the other's own and probed cells; all pairs
that meet are verified by their cosine in double precision.

Tables, blocks and scale are the same at any size, so whether a pair meets follows from its two vectors alone: other vectors,
however many, neither add nor take a link.  Two unrelated vectors share a cell with probability 1e-9, so that cells stay
small in labels of hundreds of millions; a pair of cosine 0.98 in 64 dimensions meets with probability 0.9997, pairs of more
with more.

Equal vectors of a label are one class with a multiplicity, so copies cost nothing.  Cells with one entry are dropped
before vectors move.  Cells with more than CELL entries are dealt out as pairs of blocks of entries, so any cell is
worked on by many tasks and none holds more than two blocks.  A pair that meets in several tables counts in the first:
both vectors' cells are known wherever they meet, for cells follow from the vectors.  Pairs are never written as rows;
a task gives for each of its vectors the links that it counted and a root within the task.

Cases: a null label, and a vector that is null, zero, of another length than most of its partners, or has null or
non-finite components, links with nothing and is its own component; finite components of any magnitude are compared; equal
rows are separate vectors if their ids differ, while rows of one id and vector count as one; an empty table gives no rows;
extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import components, cut, hot_join, table

THRESHOLD = 0.98
TABLES, PROBES, SEED = 12, 3, 8
#: (vectors of a label up to which it holds, blocks, scale): one for all sizes.
SETTINGS = ((1 << 62, 3, 0.35),)
SETTING = SETTINGS[0][1:]
CELL = 2048
#: Pairs whose cosines or cells a task compares at a time, and pairs that it holds before it counts them.
PART, HELD = 1 << 15, 1 << 18
#: Bytes of vectors that a verifying task holds at a time, about.
BIN_BYTES = 8 << 20
TOLERANCE = 1e-12


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum."""
    f = np.rint(x)
    odd = np.flatnonzero(f.sum(axis=1).astype(np.int64) % 2)
    if len(odd):
        d = x[odd] - f[odd]
        i = np.abs(d).argmax(axis=1)
        f[odd, i] += np.where(d[np.arange(len(odd)), i] >= 0, 1.0, -1.0)
    return f


def nearest_e8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest E8 points: of D8 and of D8 + 1/2 the nearer; and the point of the other coset."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    near = (((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None]
    return np.where(near, a, b), np.where(near, b, a)


@lru_cache(maxsize=8)
def projections(dim: int, blocks: int, scale: float) -> np.ndarray:
    rng = np.random.default_rng([SEED, dim])
    q = rng.standard_normal((TABLES, dim, 8 * blocks))
    return q / np.sqrt(8 * blocks) / scale


def mix(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    h = salt.astype(np.uint64)
    for k in range(points.shape[1]):
        h = (h ^ (points[:, k] * 2).astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def around(x: np.ndarray) -> list[np.ndarray]:
    """The nearest E8 points of rows of 8 numbers, and PROBES neighbours: the nearest point of the other coset, the point across
    the wall that lies in the direction of the residual, and the one across that of its two largest parts."""
    own, other = nearest_e8(x)
    away = x - own
    norm = np.sqrt((away**2).sum(axis=1, keepdims=True)) + 1e-12
    far = nearest_e8(own + away / norm)[0]
    big = np.argsort(-np.abs(away), axis=1)[:, :2]
    step, rows = np.zeros_like(x), np.arange(len(x))
    for k in range(2):
        step[rows, big[:, k]] = np.where(away[rows, big[:, k]] >= 0, 1.0, -1.0)
    return [own, other, far, own + step]


def cells(unit: np.ndarray, label: np.ndarray, setting: tuple[int, float]) -> np.ndarray:
    """(n, TABLES, 1 + PROBES * blocks): own and probed cells; a probed cell differs from the own one in one block."""
    blocks, scale = setting
    proj = projections(unit.shape[1], blocks, scale)
    out = np.empty((len(unit), TABLES, 1 + PROBES * blocks), np.int64)
    for t in range(TABLES):
        points = [p.reshape(len(unit), 8 * blocks) for p in around((unit @ proj[t]).reshape(-1, 8))]
        salt = (label.astype(np.int64) * 1_000_003 + t).view(np.uint64) if len(label) else label.astype(np.uint64)
        out[:, t, 0] = mix(points[0], salt)
        for k in range(PROBES):
            for j in range(blocks):
                near = points[0].copy()
                near[:, 8 * j : 8 * j + 8] = points[1 + k][:, 8 * j : 8 * j + 8]
                out[:, t, 1 + k * blocks + j] = mix(near, salt)
    return out


def units(batch: list) -> np.ndarray:
    """Unit vectors; scaled by their largest component first, so that no magnitude overflows or vanishes."""
    x = np.array(batch, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>, label): the vectors that can link."""
    own = vectors.selectExpr("cast(vec_id as bigint) as vec_id", "cast(embedding as array<double>) as v", "cast(label as bigint) as label")
    ok = "label is not null and vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x <> 0)"
    return own.where(ok)


def classes(vectors: DataFrame) -> DataFrame:
    """(cls, v, label, n): classes of equal vectors and labels, by their least id."""
    return usable(vectors).groupBy("label", "v").agg(F.min("vec_id").alias("cls"), F.count_distinct("vec_id").alias("n"))


def links(cls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cls, n_links): vectors of other classes linked to each; and (a, b): edges between classes that span them."""
    keyed = cls.select("cls", "label", "v", "n", F.size("v").alias("dim"), F.xxhash64("v").alias("same"))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pdf = b.to_pandas()
            for _, g in pdf.groupby("dim"):
                u = units(g["v"].tolist())
                c = cells(u, g["label"].to_numpy(), SETTING)
                flat = c.reshape(len(g), -1)
                first = np.ones_like(flat, bool)  # a probed cell may equal another
                for k in range(1, flat.shape[1]):
                    first[:, k] = (flat[:, :k] != flat[:, k : k + 1]).all(axis=1)
                who, col = np.nonzero(first)
                yield pa.RecordBatch.from_arrays([pa.array(flat[who, col]), pa.array(g["cls"].to_numpy()[who])], ["cell", "cls"])

    entries = cut(keyed.mapInArrow(enter, "cell long, cls long"))
    many = entries.groupBy("cell").agg(F.count("*").alias("m")).where("m > 1")
    nb = f"cast(ceil(m / {CELL}D) as int)"
    many = cut(many)
    met = entries.join(many, "cell").withColumn("k", F.expr(f"cast(pmod(xxhash64(cls), {nb}) as int)")).withColumn("o", F.explode(F.expr(f"sequence(0, {nb} - 1)")))
    met = met.select("cell", F.least("k", "o").alias("lo"), F.greatest("k", "o").alias("hi"), "k", "cls")
    # cells go to tasks in groups by a hash, so that small cells do not each cost a call; as many groups as the vectors need
    width, rows = keyed.agg(F.coalesce(F.avg("dim"), F.lit(0.0))).first()[0], many.agg(F.coalesce(F.sum(F.expr(f"m * {nb}")), F.lit(0))).first()[0]
    bins = max(64, int(rows * (8 * width + 64) / BIN_BYTES))
    full = met.join(keyed, "cls").withColumn("bin", F.pmod(F.xxhash64("cell", "lo", "hi"), F.lit(bins)))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        found: dict[int, int] = {}
        edges: list[tuple[int, int]] = []
        for _, d in pdf.groupby("dim", sort=False):
            order = np.lexsort((d["same"], d["cls"]))  # classes of one least id are told apart
            new = np.r_[True, np.diff(d["cls"].to_numpy()[order]) | np.diff(d["same"].to_numpy()[order]) != 0]
            row, at = order[new], np.empty(len(order), np.int64)
            at[order] = np.cumsum(new) - 1
            ids = d["cls"].to_numpy()[row]
            mult, label, u = d["n"].to_numpy()[row], d["label"].to_numpy()[row], units(d["v"].iloc[row].tolist())
            held: list[tuple[np.ndarray, ...]] = []
            size = 0
            for (cell, lo, hi), g in d[["cell", "lo", "hi", "k"]].assign(at=at).groupby(["cell", "lo", "hi"], sort=False):
                left, right = (np.unique(g["at"].to_numpy()[g["k"].to_numpy() == x]) for x in (lo, hi))
                step = max(1, PART // max(1, len(right)))
                for s in range(0, len(left), step):
                    i, j = np.nonzero(u[left[s : s + step]] @ u[right].T >= THRESHOLD - TOLERANCE)
                    i, j = left[s + i], right[j]
                    keep = (i < j) if lo == hi else (i != j)
                    i, j = i[keep], j[keep]
                    sure = np.einsum("ij,ij->i", u[i], u[j]) >= THRESHOLD
                    if sure.any():
                        held.append((np.minimum(i, j)[sure], np.maximum(i, j)[sure], np.full(int(sure.sum()), cell)))
                        size += len(held[-1][0])
                    if size >= HELD:
                        edges += counted(ids, mult, label, u, held, found)
                        held, size = [], 0
            if held:
                edges += counted(ids, mult, label, u, held, found)
        n = len(found)
        out = {"cls": [*found, *(a for a, _ in edges)], "n_links": [*found.values(), *[0] * len(edges)], "root": [*[None] * n, *(b for _, b in edges)]}
        return pd.DataFrame(out).astype({"cls": "int64", "n_links": "int64"}).assign(root=pd.array(out["root"], "Int64"))

    out = cut(full.groupBy("bin").applyInPandas(verify, "cls long, n_links long, root long"))
    return out.where("root is null").groupBy("cls").agg(F.sum("n_links").alias("n_links")), out.where("root is not null").select(F.col("cls").alias("a"), F.col("root").alias("b"))


def counted(ids: np.ndarray, mult: np.ndarray, label: np.ndarray, u: np.ndarray, held: list[tuple[np.ndarray, ...]], found: dict[int, int]) -> list[tuple[int, int]]:
    """Adds to found the links of pairs that meet first in the cell where they were found, and returns links that span them."""
    i, j, cell = (np.concatenate(x) for x in zip(*held, strict=True))
    used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j = back[: len(i)], back[len(i) :]
    c = cells(u[used], label[used], SETTING)
    here = np.zeros(len(i), bool)
    for s in range(0, len(i), PART):
        live = np.arange(s, min(s + PART, len(i)))
        for t in range(TABLES):
            a, b = c[i[live], t], c[j[live], t]
            by_a = (a[:, :1] == b).any(axis=1)  # a's own cell is one of b's
            met = by_a | (b[:, :1] == a).any(axis=1)
            here[live] = met & (np.where(by_a, a[:, 0], b[:, 0]) == cell[live])
            live = live[~met]
            if not len(live):
                break
    i, j, ids, mult = i[here], j[here], ids[used], mult[used]
    got = np.bincount(i, mult[j], len(ids)) + np.bincount(j, mult[i], len(ids))
    for k in np.flatnonzero(got):
        found[int(ids[k])] = found.get(int(ids[k]), 0) + int(got[k])
    return spanning(ids, i, j)


def spanning(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Links from each linked vector to the least one that it reaches within the task."""
    low = np.arange(len(ids))
    while True:
        new = low.copy()
        m = np.minimum(low[i], low[j])
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if (new == low).all():
            break
        low = new
    moved = np.flatnonzero(low != np.arange(len(ids)))
    return [(int(ids[k]), int(ids[low[k]])) for k in moved]


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of the table."""
    own = cut(vectors.selectExpr("cast(vec_id as bigint) as vec_id", "embedding", "label"))
    cls = cut(classes(own))
    n_links, edges = links(cls)
    roots = components(edges)
    # a vector that a third of all rows repeat is one key here and in what follows
    same = F.xxhash64("label", "v").alias("same")
    member = cut(hot_join(usable(own).select("vec_id", "label", "v", same), cls.select("label", "v", "cls", "n", same), "same", extra=("label", "v")).select("vec_id", "cls", "n"))
    known = hot_join(member, n_links.join(roots.withColumnRenamed("node", "cls"), "cls", "full"), "cls", "left")
    known = known.select("vec_id", (F.col("n") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.coalesce("root", "cls").alias("root"))
    known = known.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("root").alias("root"))
    out = own.select("vec_id").join(known, "vec_id", "left")
    comp = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(True)).alias("kept"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
