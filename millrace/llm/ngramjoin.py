"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document's set is that of its different 5-word shingles (A-Z lower-cased; fewer words: the whole sequence as one), held
as 64-bit hashes.  Documents of equal sets are one class.  One order of all shingles, rarest first by a count sketch of
fixed size over the corpus, fixes prefixes: two sets that link share at least T = ceil(0.75 n) shingles of each, so
their prefixes of n - T + l shingles share at least l.  l is chosen per set by estimated cost: a longer prefix adds
postings but asks for more shared shingles before a pair is verified; of two sets the smaller l holds for the pair.

1. One pass over the texts counts shingles into the sketch and gives (doc_id, n, class).
2. A second pass emits prefixes, packed by shingle shards; a shard's reducer finds the classes that share shingles, in runs
   of bounded size.  Lists of up to LIST classes give all their pairs; longer lists give pairs with their first class, and
   are kept as rows.
3. Each class's best pair, and that with what leads it in a long list, is verified exactly, on whole sets that a third pass
   fetches for the classes named in pairs.  A class in many pairs meets its partners in salted groups, and its set is read
   once a group.  Links found so far are brought to components.
4. All other pairs that fit, and all pairs of long lists that could share enough after the place where they meet, are
   verified if their components still differ.  No pair that could join two components is left out, so the components are
   exact; pairs inside one component need no work.

A class is named by 80 bits of a hash of its set; within a shard a shingle by 32 bits, so that two may be taken for one: that
adds candidates, which are verified on whole 64-bit hashes.

Cases: a null or blank text has an empty set and is linked with nothing; equal rows are separate documents of one class;
a null doc_id is linked like any other and never names a component; empty tables give no rows; texts are read whole,
whatever their length; no columns but doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import M2, components, cut, hot_join, lean, mixed, table, text_runs, word_hashes

WIDTH, PERCENT = 5, 75
SKETCH, SKETCH_PARTS = 1 << 20, 16
MOST_MATCHES = 4
#: Cost of verifying a pair, in postings.
VERIFY = 16.0
LIST = 48
PARITY = 512
#: Shingles that a task holds before it passes them on, and pairs that a reducer counts at a time.
FLUSH, RUN = 1_000_000, 2_000_000
#: Pairs that a reducer gives at a time: the JVM holds each such batch beside its heap.
BATCH = 1 << 16
#: Bytes of a class's name.
NAME = 10
#: Bits of the filter for each named class, and of a filter at most; more classes are fetched in several passes.
NAME_BITS, BLOOM_BITS = 16, 1 << 27
#: Partners of a class that are verified in one group.
GROUP = 512


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted different shingle hashes of each text."""
    for run in text_runs(texts):
        w, n = word_hashes(run)
        h = w
        for k in range(1, WIDTH):
            h = mixed(h[:-1]) + w[k:]
        h = mixed(h)
        at = 0
        for k in n.tolist():
            if k >= WIDTH:
                s = np.sort(h[at : at + k - WIDTH + 1])
                new = s[1:] != s[:-1]
                yield s if new.all() else s[np.r_[True, new]]
            elif k:
                s = np.array([k], np.uint64)
                for x in w[at : at + k]:
                    s = mixed(s * M2 + x)
                yield s
            else:
                yield np.zeros(0, np.uint64)
            at += k


def class_of(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())[:NAME]


def first_pass(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n, cls, and key where docs has it) of the documents, and rows (part, salt, payload) of the tasks' sketches."""
    extra = ["key"] if "key" in docs.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = np.zeros(SKETCH, np.uint32), 0
        names = ["doc_id", "n", "cls", "part", "salt", "payload", *extra]
        for b in batches:
            n, cls, held, size = [], [], [], 0
            for s in shingle_sets(b.column("text")):
                n.append(len(s))
                cls.append(class_of(s))
                held.append((s >> np.uint64(44)).astype(np.int32))
                size += len(s)
                if size > FLUSH:
                    sketch += np.bincount(np.concatenate(held), minlength=SKETCH).astype(np.uint32)
                    held, size = [], 0
            if held:
                sketch += np.bincount(np.concatenate(held), minlength=SKETCH).astype(np.uint32)
            seen += sum(n)
            k = len(n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), *(b.column(x) for x in extra)], names)
        if seen:
            parts = [zlib.compress(x.tobytes(), 1) for x in np.split(sketch, SKETCH_PARTS)]
            salt = int(sketch[:64].sum()) % 256
            k = len(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array([salt] * k, pa.int32()), pa.array(parts, pa.binary()), *(pa.nulls(k, pa.string()) for _ in extra)], names)

    return docs.mapInArrow(lean(run), "doc_id long, n long, cls binary, part int, salt int, payload binary" + "".join(f", {x} string" for x in extra))


def sketch_of(rows: DataFrame) -> np.ndarray:
    """The sum of the sketches, in two steps; SKETCH counters whatever the corpus."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.int64) for x in pdf["payload"])
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "salt": [0], "payload": [zlib.compress(np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)]})

    kind = "part int, salt int, payload binary"
    own = rows.where("part is not null").select("part", "salt", "payload")
    summed = own.groupBy("part", "salt").applyInPandas(add, kind).groupBy("part").applyInPandas(add, kind)
    out = np.zeros(SKETCH, np.uint32)
    for part, _, raw in summed.toLocalIterator():
        size = SKETCH // SKETCH_PARTS
        out[part * size : (part + 1) * size] = np.frombuffer(zlib.decompress(raw), np.uint32)
    return out


def prefix(s: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, int]:
    """The shingles of the prefix, and the number l that a partner must share."""
    n = len(s)
    must = -(-PERCENT * n // 100)
    count = sketch[(s >> np.uint64(44)).astype(np.int64)].astype(np.float64)
    order = np.lexsort((s, count))
    upto = np.cumsum(count[order])
    best, best_cost = 1, np.inf
    for matches in range(1, min(MOST_MATCHES, must) + 1):
        postings = upto[n - must + matches - 1]
        cost = postings + VERIFY * postings / matches**2
        if cost < best_cost:
            best, best_cost = matches, cost
    return s[order[: n - must + best]], best


def postings(docs: DataFrame, sketch: np.ndarray, shards: int) -> DataFrame:
    """(shard, payload): owners (class, n and l in one number, number of shingles) and their prefix shingles in that shard, as
    32 bits, each with its place in the prefix in 256ths, rounded down.  An owner of more than 255 stands several times."""
    held = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        own: list[tuple[bytes, int]] = []
        tokens: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            flat = np.concatenate(tokens)
            sizes = np.array([len(t) for t in tokens])
            owner = np.repeat(np.arange(len(own), dtype=np.int32), sizes)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            place = (256 * place // sizes[owner]).astype(np.uint8)
            shard = (flat % np.uint64(shards)).astype(np.int32)
            flat = (flat >> np.uint64(24)).astype(np.uint32)
            order = np.argsort(shard, kind="stable")  # owners stay in order within
            flat, owner, place, shard = flat[order], owner[order], place[order], shard[order]
            edge = np.searchsorted(shard, np.arange(shards + 1))
            cls = np.frombuffer(b"".join(c for c, _ in own), f"V{NAME}")
            nl = np.array([x for _, x in own], np.uint32)
            ids, raw = [], []
            for k in range(shards):
                a, b = edge[k], edge[k + 1]
                if a == b:
                    continue
                who, cnt = np.unique(owner[a:b], return_counts=True)
                if cnt.max() > 255:
                    full = -(-cnt // 255)
                    last = cnt - 255 * (full - 1)
                    who, cnt = np.repeat(who, full), np.full(full.sum(), 255)
                    cnt[np.cumsum(full) - 1] = last
                ids.append(k)
                raw.append(np.uint32(len(who)).tobytes() + cls[who].tobytes() + nl[who].tobytes() + cnt.astype(np.uint8).tobytes() + flat[a:b].tobytes() + place[a:b].tobytes())
            own.clear()
            tokens.clear()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(raw, pa.binary())], ["shard", "payload"])

        for b in batches:
            for s in shingle_sets(b.column("text")):
                if len(s) and (c := class_of(s)) not in seen:
                    seen.add(c)
                    p, l = prefix(s, held.value)
                    own.append((c, len(s) << 2 | l - 1))
                    tokens.append(p)
                    size += len(p)
                    if size >= FLUSH:
                        yield from flush()
                        size = 0
        if own:
            yield from flush()

    return docs.select("text").mapInArrow(lean(run), "shard int, payload binary")


def read_posting(raw: bytes) -> tuple[np.ndarray, ...]:
    """Classes, n, l, and for each shingle its owner's number, itself, and its place."""
    k = int(np.frombuffer(raw, np.uint32, 1)[0])
    cls = np.frombuffer(raw, f"V{NAME}", k, 4)
    nl = np.frombuffer(raw, np.uint32, k, 4 + NAME * k)
    cnt = np.frombuffer(raw, np.uint8, k, 4 + (NAME + 4) * k)
    at = 4 + (NAME + 5) * k
    flat = np.frombuffer(raw, np.uint32, int(cnt.sum()), at)
    place = np.frombuffer(raw, np.uint8, len(flat), at + 4 * len(flat))
    return cls, (nl >> np.uint32(2)).astype(np.int64), (nl & np.uint32(3)).astype(np.int64) + 1, np.repeat(np.arange(k), cnt), flat, place


PAIRS = "token long, a binary, b binary, na long, nb long, l int, shared int, place int"


def named_batch(uniq: np.ndarray, token: np.ndarray | None, a: np.ndarray, b: np.ndarray | None, na: np.ndarray, nb: np.ndarray, l: np.ndarray, shared: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    name = lambda i: pa.Array.from_buffers(pa.binary(NAME), len(i), [None, pa.py_buffer(uniq[i].tobytes())]).cast(pa.binary())
    k = len(a)
    cols = [pa.nulls(k, pa.int64()) if token is None else pa.array(token, pa.int64()), name(a), pa.nulls(k, pa.binary()) if b is None else name(b)]
    cols += [pa.array(x, t) for x, t in ((na, pa.int64()), (nb, pa.int64()), (l.astype(np.int32), pa.int32()), (shared.astype(np.int32), pa.int32()), (place.astype(np.int32), pa.int32()))]
    return pa.RecordBatch.from_arrays(cols, ["token", "a", "b", "na", "nb", "l", "shared", "place"])


def reduce_shard(shard: int, shards: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Pairs of classes that share shingles of the shard (shared: how many; place: 1 where one leads the other in a long list, which
    leaves open how many more), and rows (token, a, na, l, place) of long lists.  A pair may come in several rows, whose
    shared add up."""
    got = [read_posting(x) for x in payloads]
    cls = np.concatenate([g[0] for g in got])
    sizes = [len(g[0]) for g in got]
    base = np.cumsum([0, *sizes])
    uniq, first, back = np.unique(cls, return_index=True, return_inverse=True)
    n, l = np.concatenate([g[1] for g in got])[first], np.concatenate([g[2] for g in got])[first]
    # of a class that several payloads hold, that of the first counts
    source = np.repeat(np.arange(len(got)), sizes)
    real = source == source[first][back]
    owner = np.concatenate([g[3] + b for g, b in zip(got, base, strict=False)])
    flat, place = np.concatenate([g[4] for g in got]), np.concatenate([g[5] for g in got])
    del got, cls
    if not real.all():
        keep = real[owner]
        owner, flat, place = owner[keep], flat[keep], place[keep]
    owner = back[owner].astype(np.int32)
    order = np.argsort(flat, kind="stable")
    flat, owner, place = flat[order], owner[order], place[order]
    del order, back, real, source
    start = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    size = np.diff(np.append(start, len(flat)))
    k = len(uniq)
    # of a long list the class that stands earliest, over the long lists of the shard, leads: one with few rare shingles of
    # its own, such as what its near copies were made from, if that is there
    spans = [slice(start[x], start[x] + size[x]) for x in np.flatnonzero(size > LIST)]
    weight = np.zeros(k)
    for x in spans:
        np.add.at(weight, owner[x], 256.0 - place[x])
    in_long = weight > 0

    def counted(parts: list[np.ndarray], led: int) -> Iterator[pa.RecordBatch]:
        code, shared = np.unique(np.concatenate(parts), return_counts=True)
        a, b = code // k, code % k
        fits = (a != b) & (100 * np.minimum(n[a], n[b]) >= PERCENT * np.maximum(n[a], n[b]))
        a, b, shared = a[fits], b[fits], shared[fits]
        shared = shared + np.where(in_long[a] | in_long[b], MOST_MATCHES, 0)  # long lists leave open how many more there are
        for at in range(0, len(a), BATCH):
            x, y, both = a[at : at + BATCH], b[at : at + BATCH], shared[at : at + BATCH]
            yield named_batch(uniq, None, x, y, n[x], n[y], np.minimum(l[x], l[y]), both, np.full(len(x), led))

    parts, held = [], 0
    for m in range(2, LIST + 1):
        s = start[size == m]
        i, j = np.triu_indices(m, 1)
        step = max(1, RUN // len(i))
        for at in range(0, len(s), step):
            some = s[at : at + step, None]
            a, b = owner[some + i].ravel().astype(np.int64), owner[some + j].ravel()
            parts.append(np.minimum(a, b) * k + np.maximum(a, b))
            held += len(a)
            if held >= RUN:
                yield from counted(parts, 0)
                parts, held = [], 0
    if parts:
        yield from counted(parts, 0)
    parts, held = [], 0
    for x in spans:
        own, at = owner[x].astype(np.int64), place[x]
        lead = own[np.argmax(weight[own])]
        parts.append(np.minimum(lead, own) * k + np.maximum(lead, own))
        held += len(own)
        token = np.full(len(own), (int(flat[x.start]) * shards + shard) & (1 << 63) - 1, np.int64)
        yield named_batch(uniq, token, own, None, n[own], np.zeros(len(own), np.int64), l[own], np.zeros(len(own), np.int64), at)
        if held >= RUN:
            yield from counted(parts, 1)
            parts, held = [], 0
    if parts:
        yield from counted(parts, 1)


def reduced(posted: DataFrame, shards: int) -> DataFrame:
    """reduce_shard over all shards: a task takes its shards one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, payloads = -1, []
        for b in batches:
            for own, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if own != shard and payloads:
                    yield from reduce_shard(shard, shards, payloads)
                    payloads = []
                shard = own
                payloads.append(raw)
        if payloads:
            yield from reduce_shard(shard, shards, payloads)

    return posted.repartition("shard").sortWithinPartitions("shard").mapInArrow(lean(run), PAIRS)


def bloom_of(names: DataFrame, bits: int) -> np.ndarray:
    """A filter of so many bits over the classes; what it lets through besides is only fetched in vain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for b in batches:
            if b.num_rows:
                at = spots(np.frombuffer(b"".join(b.column(0).to_pylist()), f"V{NAME}"), bits)
                np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], ["bits"])

    out = np.zeros(bits // 8, np.uint8)
    for (raw,) in names.coalesce(16).mapInArrow(lean(run), "bits binary").toLocalIterator():
        out |= np.frombuffer(zlib.decompress(raw), np.uint8)
    return out


def spots(cls: np.ndarray, bits: int) -> np.ndarray:
    a = np.frombuffer(cls.tobytes(), np.uint8).reshape(-1, NAME)[:, :8].copy().view(np.uint64)[:, 0]
    b = mixed(a) | np.uint64(1)
    return np.concatenate([((a + np.uint64(i) * b) % np.uint64(bits)).astype(np.int64) for i in range(4)])


def sets_of(docs: DataFrame, names: DataFrame, form: Callable[[np.ndarray], bytes] = np.ndarray.tobytes) -> DataFrame:
    """(cls, s): the whole sets of the named classes, or what form makes of each.  names: different classes, materialised."""
    count = names.count()
    bits = 1 << max(13, min(BLOOM_BITS.bit_length() - 1, int(count * NAME_BITS).bit_length()))
    passes = max(1, -(-count * NAME_BITS // (2 * BLOOM_BITS)))

    def fetched(names: DataFrame) -> DataFrame:
        held = docs.sparkSession.sparkContext.broadcast(bloom_of(names, bits))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filter_, seen = held.value, set()
            for b in batches:
                cls, sets, size = [], [], 0
                for s in shingle_sets(b.column("text")):
                    c = class_of(s)
                    if len(s) and c not in seen:
                        at = spots(np.frombuffer(c, f"V{NAME}"), bits)
                        if ((filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all():
                            seen.add(c)
                            cls.append(c)
                            sets.append(form(s))
                            size += len(sets[-1])
                            if size > FLUSH:
                                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(sets, pa.binary())], ["cls", "s"])
                                cls, sets, size = [], [], 0
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(sets, pa.binary())], ["cls", "s"])

        return docs.select("text").mapInArrow(lean(run), "cls binary, s binary")

    every = [fetched(names if passes == 1 else names.where(F.pmod(F.crc32("cls"), F.lit(passes)) == i)) for i in range(passes)]
    return reduce(DataFrame.union, every).groupBy("cls").agg(F.first("s").alias("s"))  # equal for one class


def parity(s: np.ndarray) -> bytes:
    """A bit for each of PARITY parts of the shingles: whether a set has an odd number there.  Two sets differ in as many
    shingles at least as in bits."""
    return np.packbits(np.bincount((s >> np.uint64(64 - PARITY.bit_length() + 1)).astype(np.int64), minlength=PARITY) & 1).tobytes()


def parities(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(cls, bits): the parities of the named classes as longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [np.frombuffer(x, np.int64).tolist() for x in b.column("s").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("cls"), pa.array(bits, pa.list_(pa.int64()))], ["cls", "bits"])

    return sets_of(docs, names, parity).mapInArrow(lean(run), "cls binary, bits array<long>")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b), materialised, whose whole sets link.  Of a pair the class in more pairs leads; a lead's set stands before
    its partners' sets, in groups of about GROUP partners, so no set is copied into each pair."""
    names = cut(pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("c")))
    sets = sets_of(docs, names.select("cls"))
    degree = lambda c, name: names.select(F.col("cls").alias(c), F.col("c").alias(name))
    known = pairs.select("a", "b").join(degree("a", "ca"), "a").join(degree("b", "cb"), "b")
    first = F.col("ca") >= F.col("cb")
    led = known.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("lead"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("cls"), F.ceil(F.greatest("ca", "cb") / GROUP).cast("int").alias("groups"))
    led = cut(led.withColumn("g", F.pmod(F.xxhash64("cls"), F.col("groups")).cast("int")))
    heads = led.select(F.col("lead").alias("cls"), "g").distinct().join(sets, "cls").select(F.col("cls").alias("lead"), "g", F.lit(None).cast("binary").alias("cls"), "s")
    rows = heads.union(led.select("lead", "g", "cls").join(sets, "cls").select("lead", "g", "cls", "s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whose, p = None, np.zeros(0, np.uint64)
        for b in batches:
            lead, cls, s = b.column(0), b.column(2), b.column(3)
            off, raw = np.frombuffer(s.buffers()[1], np.int32)[s.offset : s.offset + len(s) + 1], s.buffers()[2]
            ok = np.zeros(len(s), bool)
            for i in range(len(s)):
                q = np.frombuffer(raw, np.uint64, (off[i + 1] - off[i]) // 8, off[i])
                if not cls[i].is_valid:
                    whose, p = lead[i].as_py(), q.copy()
                elif lead[i].as_py() == whose:
                    both = shared_size(p, q)
                    ok[i] = 100 * both >= PERCENT * (len(p) + len(q) - both)
            yield pa.RecordBatch.from_arrays([lead, cls], ["lead", "cls"]).filter(pa.array(ok))

    met = rows.repartition("lead", "g").sortWithinPartitions("lead", "g", F.col("cls").asc_nulls_first())
    return met.mapInArrow(lean(run), "lead binary, cls binary").select(F.least("lead", "cls").alias("a"), F.greatest("lead", "cls").alias("b"))


def shared_size(p: np.ndarray, q: np.ndarray) -> int:
    """How many the two sorted sets share."""
    if len(p) > len(q):
        p, q = q, p
    return int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())


def pairs_across(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): pairs of long lists' rows (token, a, na, l, place, ra) that could link and lie in different components.

    Shingles stand in one order in all sets, so where two sets first meet in a long list, each shares with the other no
    more than what it has from that place on and the MOST_MATCHES - 1 shingles of short lists before.  That gives the
    largest partner that a row may have.  Rows meet by bands of the smaller set's size: a row stands in its own band as
    the smaller, and in all bands that its partners may have as the larger.  Pairs whose parities differ more than the
    sets may are left out."""
    band = lambda n: f"cast(floor(ln({n}) / ln(1.1D)) as int)"
    rows = rows.withColumn("rest", F.expr(f"na + {MOST_MATCHES - 1} - (place * (na - ({PERCENT} * na + 99) div 100 + l)) div 256"))
    rows = rows.withColumn("most", F.expr(f"({100 + PERCENT} * rest) div {PERCENT} - na")).withColumn("least", F.expr(f"({PERCENT} * na + 99) div 100"))
    rows = cut(rows.where("most >= least"))
    small = rows.where("most >= na").withColumn("band", F.expr(band("na")))
    large = rows.withColumn("band", F.explode(F.expr(f"sequence({band('least')}, {band('least(most, na)')})")))
    sides = small.select("token", "band", "ra", F.lit(1).alias("s")).union(large.select("token", "band", "ra", F.lit(0).alias("s")))
    open_ = cut(sides.groupBy("token", "band").agg(F.min("ra").alias("x"), F.max("ra").alias("y"), F.max("s").alias("s")).where("x <> y and s = 1").select("token", "band"))
    small, large = cut(small.join(open_, ["token", "band"], "left_semi")), cut(large.join(open_, ["token", "band"], "left_semi"))
    names = cut(small.select(F.col("a").alias("cls")).union(large.select(F.col("a").alias("cls"))).distinct())
    if names.isEmpty():
        return rows.select("a", F.col("a").alias("b")).limit(0)
    bits = cut(parities(docs, names))
    flat = lambda c: [F.col("bits")[i].alias(f"{c}{i}") for i in range(PARITY // 64)]
    small = small.join(bits, small["a"] == bits["cls"]).select("token", "band", F.col("a").alias("b"), F.col("na").alias("nb"), F.col("ra").alias("rb"), F.col("most").alias("most_b"), *flat("q"))
    large = large.join(bits, large["a"] == bits["cls"]).select("token", "band", "a", "na", "ra", "most", "least", *flat("p"))
    differ = " + ".join(f"bit_count(p{i} ^ q{i})" for i in range(PARITY // 64))
    fits = f"nb between least and most and na <= most_b and {differ} <= na + nb - 2 * (({PERCENT} * (na + nb) + {99 + PERCENT}) div {100 + PERCENT})"
    met = large.join(small, ["token", "band"]).where(f"ra <> rb and (na > nb or na = nb and a < b) and {fits}")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def class_components(docs: DataFrame, sketch: np.ndarray, n_docs: int) -> DataFrame:
    """(node, root) over the classes that link with another class."""
    shards = 1 << max(4, int(n_docs // 8000).bit_length())
    found = cut(reduced(postings(docs, sketch, shards), shards))
    pairs = found.where("token is null").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("l").alias("l"), F.max("place").alias("led")).where("shared >= l")
    pairs = cut(pairs.select("a", "b", "shared", "led"))
    either = pairs.select("a", F.col("b").alias("o"), "shared").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("o"), "shared"))
    best = either.groupBy("a").agg(F.max(F.struct("shared", "o")).alias("m")).select(F.least("a", "m.o").alias("a"), F.greatest("a", "m.o").alias("b"))
    best = cut(best.union(pairs.where("led = 1").select("a", "b")).distinct())
    roots = cut(components(verified(best, docs)))
    root = lambda d, c, name: hot_join(d, roots.select(F.col("node").alias(c), F.col("root").alias(name)), c, "left").withColumn(name, F.coalesce(name, c))
    rest = root(cut(root(pairs.select("a", "b"), "a", "ra")), "b", "rb").where("ra <> rb").select("a", "b")
    rows = found.where("token is not null").select("token", "a", "na", "l", "place")
    if not rows.isEmpty():
        rest = rest.union(pairs_across(root(rows, "a", "ra"), docs))
    rest = cut(rest.distinct().join(best, ["a", "b"], "left_anti"))
    if rest.isEmpty():
        return roots
    # what links further joins whole components: only their roots are left to be brought together
    more = cut(verified(rest, docs))
    joined = components(root(cut(root(more, "a", "ra")), "b", "rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    lone = more.select(F.col("a").alias("node")).union(more.select(F.col("b").alias("node"))).distinct().join(roots, "node", "left_anti").withColumn("root", F.col("node"))
    joined = joined.select(F.col("node").alias("root"), F.col("root").alias("new"))
    return hot_join(cut(roots.union(lone)), joined, "root", "left").select("node", F.coalesce("new", "root").alias("root"))


def classed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, comp): a row per document of (doc_id, text, and key where there is one); comp is null for an empty set."""
    first = cut(first_pass(docs))
    rows = first.where("part is null").drop("part", "salt", "payload")
    roots = class_components(docs.select("text"), sketch_of(first), rows.count())
    named = hot_join(rows, roots.select(F.col("node").alias("cls"), "root"), "cls", "left")
    return named.withColumn("comp", F.when(F.col("n") > 0, F.coalesce("root", "cls"))).drop("cls", "root")


def members(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): a row per document."""
    named = cut(classed(docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")).withColumnRenamed("n", "n_shingles"))
    least = named.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("low"))
    return hot_join(named, least, "comp", "left").select("doc_id", "n_shingles", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, of the least id (nulls last), with its own columns.  Rows are told apart by id and
    text, so equal or null ids in different components all stay, and so do all rows of empty sets, linked with nothing."""
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary"))
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), key.alias("key"))
    named = cut(classed(own))
    least = named.where("comp is not null").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("m"))
    alone = named.where("comp is null").select("key", F.lit(True).alias("_alone")).distinct()
    stay = alone.union(least.select("m.key", F.lit(False))).withColumnRenamed("key", "_key")
    # rows that repeat id and text are one document's copies, and one of them stays
    kept = docs.withColumn("_key", key).join(stay, "_key").withColumn("_row", F.when(F.col("_alone"), F.monotonically_increasing_id()))
    one = kept.groupBy("_key", "_row").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_one"))
    return one.select("_one.*")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(table(spark, sf_dir, "documents"))
