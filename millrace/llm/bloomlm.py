"""Language-model scoring from a log-frequency Bloom filter.

Tokens are the words of a text, A-Z lower-cased, and one end token.  Unigram counts are exact; all pairs of
tokens are held in a Bloom filter as quantised counts: a pair of count c is entered as the items
(pair, 1) ... (pair, q), q = 1 + floor(log2 c), so that probing (pair, 1), (pair, 2), ... until one is absent gives q,
never less than the true one.  The filter is a row of regions, one for each shard of pairs, that the reducers of the shards
fill, so counts never meet on the driver.  A region has BITS_PER_ITEM bits for each of its items, so an absent pair is taken
for one of count 1 with probability 0.0065, and each further level as seldom, at any corpus size.  A filter of up to FILTER_BYTES is
broadcast; the regions of a larger one stay distributed, and the pairs of blocks of documents go to their regions by a
shuffle on shard and come back as levels.  Both ways give the same.  The bound is
low, since each task's worker holds a copy.

Where the documents that are scored are those learned from (learned_scores, which the query takes), the pairs travel once at any
size: a block's pairs go to their shard with their counts in the block's training texts, and the shard's reducer fills its
region from them and answers from it.  So no pair is shuffled both to be counted and to be looked up, and no region leaves its
reducer.  Scores are those of score(docs, learn(docs)).

Probability of w after v, pairs backed by unigrams: lam * c(v, w) / c(v) + (1 - lam) * p(w), with
lam = c(v) / (c(v) + SMOOTH) * MOST, c(v, w) the lower end of its quantised class, 2^(q - 1), so never above the true count,
and p(w) = (c(w) + 1) / (N + V + 1).  As the true counts of all w after v add up to c(v), the probabilities after v, that
of one unknown word included, add up to 1 at most, and, as no class is wider than a factor of 2, to 1 - lam / 2 at least
(the filter's false positives aside).

Unigram counts of up to MAX_BROADCAST different tokens are broadcast; beyond that size the different tokens of each block go
to the counts of their shard, by the same shuffle as the pairs, and come back as counts.  Both ways give the same.

Cases: a null text is empty and scores its end token; documents are told apart by their rows, not their ids; a null id
hashes as the text 'null'; empty tables give no rows; texts of any length are read whole; no column but doc_id and
text is read.  The documents are read twice where the filter or the counts are not broadcast, and must come in the same
order: a scan or a checkpoint does, anything else is checkpointed first, and a block that came otherwise is found out and fails.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import M1, M2, crc_bucket, crc_bucket_col, cut, mixed, table, text_runs, word_hashes

MODULUS, HELD = 7, 2
FILTER_BYTES, BITS_PER_ITEM, PROBES = 8 << 20, 12, 4
MAX_BROADCAST = 4_000_000
SMOOTH, MOST = 20.0, 0.75
END, START = np.uint64(xxhash.xxh64_intdigest(b" end")), np.uint64(xxhash.xxh64_intdigest(b" start"))
#: Tokens that a task counts before it passes the counts on.
FLUSH = 2_000_000
#: Documents whose pairs are looked up together in distributed regions have about so many bytes, or are one document.
BLOCK_BYTES = 8 << 20
#: Of a pair's key, the part that tells it from others of its shard; the bits above choose the shard.
KEY_BITS = 40
LOW = np.uint64((1 << KEY_BITS) - 1)
#: Training tokens of a shard at most, about, where shards are chosen after tokens are counted.
SHARD_TOKENS = 1_500_000


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(v * M2 + mixed(w))


def token_runs(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Token hashes of runs of texts, and where each text of the run begins; the last edge is the end."""
    for run in text_runs(texts):
        w, n = word_hashes(run)
        edge = np.r_[0, np.cumsum(n + 1)]
        ids = np.full(edge[-1], END)
        inner = np.ones(len(ids), bool)
        inner[edge[1:] - 1] = False
        ids[inner] = w
        yield ids, edge


def shifted(x: np.ndarray, edge: np.ndarray, first: object) -> np.ndarray:
    """What stands before each entry of x in its text; first at a text's begin."""
    out = np.roll(x, 1)
    out[edge[:-1]] = first
    return out


def compact(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard and low KEY_BITS of the keys, in this order of bits."""
    return shard_of(keys, shards).astype(np.uint64) << np.uint64(KEY_BITS) | keys & LOW


def pack_keys(low: np.ndarray) -> bytes:
    """Sorted different keys of one shard: as steps of 4 bytes, or whole where a step is too wide."""
    steps = np.diff(low, prepend=np.uint64(0))
    if steps.max(initial=0) < 1 << 32:
        return b"\0" + steps.astype("<u4").tobytes()
    return b"\1" + np.ascontiguousarray(low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]).tobytes()


def unpack_keys(raw: bytes, n: int, at: int = 0) -> tuple[np.ndarray, int]:
    """n keys, and where they end."""
    if raw[at] == 0:
        return np.cumsum(np.frombuffer(raw, "<u4", n, at + 1), dtype=np.uint64), at + 1 + 4 * n
    out = np.zeros((n, 8), np.uint8)
    out[:, : KEY_BITS // 8] = np.frombuffer(raw, np.uint8, n * KEY_BITS // 8, at + 1).reshape(n, -1)
    return out.view("<u8")[:, 0], at + 1 + n * KEY_BITS // 8


def all_keys(raw: bytes) -> np.ndarray:
    return unpack_keys(raw, (len(raw) - 1) // 4 if raw[0] == 0 else (len(raw) - 1) * 8 // KEY_BITS)[0]


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted pairs of one shard with their counts: those of count 1, the others, and their counts, a byte each and more for
    large ones."""
    one = counts == 1
    more = counts[~one]
    head = np.array([one.sum(), len(more)], "<u4").tobytes()
    return head + pack_keys(keys[one]) + pack_keys(keys[~one]) + np.minimum(more, 255).astype(np.uint8).tobytes() + more[more >= 255].astype("<u4").tobytes()


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m = (int(x) for x in np.frombuffer(raw, "<u4", 2))
    a, at = unpack_keys(raw, n, 8)
    b, at = unpack_keys(raw, m, at)
    counts = np.ones(n + m, np.int64)
    counts[n:] = np.frombuffer(raw, np.uint8, m, at)
    counts[n:][counts[n:] == 255] = np.frombuffer(raw, "<u4", -1, at + m)
    return np.concatenate([a, b]), counts


def pack_counts(counts: np.ndarray) -> bytes:
    """A byte each, and more for large ones."""
    return zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u8").tobytes(), 1)


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    raw = zlib.decompress(raw)
    counts = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, "<u8", -1, n)
    return counts


def pack_tokens(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return np.array([len(keys)], "<u4").tobytes() + keys.astype("<u8").tobytes() + pack_counts(counts)


def unpack_tokens(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    return np.frombuffer(raw, "<u8", n, 4), unpack_counts(raw[4 + 8 * n :], n)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], (np.add.reduceat(counts.astype(np.int64), first) if len(keys) else counts)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(KEY_BITS)) % np.uint64(shards)).astype(np.int64)


def shard_edges(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins among sorted compact keys; the last edge is the end."""
    return np.searchsorted(keys, np.arange(shards + 1, dtype=np.uint64) << np.uint64(KEY_BITS))


def gather_counts(train: DataFrame, shards: int, pairs: bool = True) -> DataFrame:
    """(kind, shard, payload): kind 1 tokens, 2 pairs where these are asked for; each payload is one task's summed counts of one
    shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {1: [], 2: []} if pairs else {1: []}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            kinds, ids, raw = [], [], []
            for kind, parts in held.items():
                every = np.concatenate(parts)
                if kind == 1:
                    keys, counts = np.unique(every, return_counts=True)
                    at = shard_of(keys, shards)
                    order = np.argsort(at, kind="stable")
                    keys, counts, edge = keys[order], counts[order], np.searchsorted(at[order], np.arange(shards + 1))
                    put = pack_tokens
                else:
                    keys, counts = np.unique(compact(every, shards), return_counts=True)
                    keys, edge, put = keys & LOW, shard_edges(keys, shards), pack
                for s in range(shards):
                    if edge[s] < edge[s + 1]:
                        kinds.append(kind), ids.append(s), raw.append(put(keys[edge[s] : edge[s + 1]], counts[edge[s] : edge[s + 1]]))
                parts.clear()
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(ids, pa.int32()), pa.array(raw, pa.binary())], ["kind", "shard", "payload"])

        for b in batches:
            for ids, edge in token_runs(b.column("text")):
                held[1].append(ids)
                if pairs:
                    held[2].append(pair_keys(shifted(ids, edge, START), ids))
                size += len(ids)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    return train.select("text").mapInArrow(run, "kind int, shard int, payload binary")


def quantised(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64)


def positions(keys: np.ndarray, level: int, bits: np.ndarray | np.uint64) -> Iterator[np.ndarray]:
    """Bits of an item within its region: double hashing."""
    a = mixed((keys & LOW) + np.uint64((level * int(M1)) % (1 << 64)))
    b = mixed(a ^ M2) | np.uint64(1)
    return (((a + np.uint64(i) * b) % bits).astype(np.int64) for i in range(PROBES))


def fill(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The region of a shard's pairs, sized by its items."""
    q = quantised(counts)
    bits = np.zeros(max(8, int(q.sum()) * BITS_PER_ITEM // 8), np.uint8)
    for level in range(1, int(q.max(initial=0)) + 1):
        for p in positions(keys[q >= level], level, np.uint64(8 * len(bits))):
            np.bitwise_or.at(bits, p >> 3, (1 << (p & 7)).astype(np.uint8))
    return bits


def probe(filter_: np.ndarray, edge: np.ndarray, shard: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Quantised counts of the pairs, 0 where the filter has none: levels are probed until one is absent.  edge: where the
    regions begin, the last is the end."""
    start, bits = edge[shard], (8 * np.diff(edge)[shard]).astype(np.uint64)
    q = np.zeros(len(keys), np.int64)
    live = np.flatnonzero(bits)
    level = 1
    while len(live) and level < 64:
        there = np.ones(len(live), bool)
        for p in positions(keys[live], level, bits[live]):
            there &= (filter_[start[live] + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1 == 1
        live = live[there]
        q[live] = level
        level += 1
    return q


class Model:
    """The learned model as the driver holds it: the filter (regions one after the other, and where each begins) and the token
    counts only where their sizes are within bounds; regions (shard, bits) and tokens (shard, bits), the counts of token_shards
    shards, are distributed.  Without regions, pairs are counted where they are looked up."""

    def __init__(self, total: int, distinct: int, starts: int, shards: int, filter_: tuple[np.ndarray, np.ndarray] | None, regions: DataFrame | None, keys: np.ndarray | None, counts: np.ndarray | None, tokens: DataFrame, token_shards: int) -> None:
        self.total, self.distinct, self.starts, self.shards = total, distinct, starts, shards
        self.filter, self.regions, self.keys, self.counts, self.tokens, self.token_shards = filter_, regions, keys, counts, tokens, token_shards


def in_training() -> Column:
    return crc_bucket_col(F.col("doc_id"), MODULUS) != HELD


def learn(docs: DataFrame, max_broadcast: int = MAX_BROADCAST, filter_bytes: int = FILTER_BYTES, pairs: bool = True) -> Model:
    """Counts over all training documents, and the filter; filter_bytes: the largest that is broadcast; pairs: whether they are
    counted here, or where score looks up those of the same documents."""
    train = docs.where(in_training())
    starts = train.count()
    # so many shards that one holds some million pairs at any corpus size
    shards = 1 << max(5, int(starts // 4000).bit_length())
    gathered = gather_counts(train, shards, pairs)

    def reduce_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, shard = int(pdf["kind"].iloc[0]), int(pdf["shard"].iloc[0])
        parts = [(unpack_tokens if kind == 1 else unpack)(x) for x in pdf["payload"]]
        keys, counts = summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        payload = pack_tokens(keys, counts) if kind == 1 else fill(keys, counts).tobytes()
        return pd.DataFrame({"kind": [kind], "shard": [shard], "distinct": [len(keys)], "total": [int(counts.sum())], "size": [len(payload)], "payload": [payload]})

    schema = "kind int, shard int, distinct long, total long, size long, payload binary"
    counted = cut(gathered.groupBy("kind", "shard").applyInPandas(reduce_shard, schema))
    tokens, regions = counted.where("kind = 1"), counted.where("kind = 2").select("shard", F.col("payload").alias("bits"))
    total, distinct = tokens.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    whole, token_shards = None, shards
    if not pairs:
        regions = None
        shards = max(shards, 1 << int(total // SHARD_TOKENS).bit_length())
    elif counted.where("kind = 2").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] <= filter_bytes:
        parts = {shard: np.frombuffer(raw, np.uint8) for shard, raw in regions.toLocalIterator()}
        every = [parts.get(k, np.zeros(0, np.uint8)) for k in range(shards)]
        whole = np.concatenate(every), np.cumsum([0, *map(len, every)])
    keys = counts = None
    if distinct <= max_broadcast:
        got = [unpack_tokens(raw) for (raw,) in tokens.select("payload").toLocalIterator()]
        keys, counts = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]

    return Model(int(total), int(distinct), starts, shards, whole, regions, keys, counts, tokens.select("shard", F.col("payload").alias("bits")), token_shards)


def run_scores(ids: np.ndarray, edge: np.ndarray, c: np.ndarray, m: dict, levels: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """Per text of a run: tokens, known tokens, and log10 probabilities by the base model and by the whole one; c: exact
    counts of the tokens, levels: the quantised counts of sorted different pairs."""
    p = (c + 1) / (m["total"] + m["distinct"] + 1)
    before = shifted(c.astype(np.float64), edge, m["starts"])
    keys, back = np.unique(pair_keys(shifted(ids, edge, START), ids), return_inverse=True)
    q = levels(keys)[back]
    own = np.where(q > 0, np.minimum(np.exp2(q - 1), before), 0.0)
    lam = MOST * before / (before + SMOOTH)
    whole = np.log10(lam * np.divide(own, before, out=np.zeros_like(own), where=before > 0) + (1 - lam) * p)
    return [np.diff(edge), *(np.add.reduceat(x, edge[:-1]) for x in ((c > 0).astype(np.int64), np.log10(p), whole))]


def block_pairs(texts: pa.Array, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of a block's texts, compact and sorted, and where each shard begins; the last edge is the end."""
    parts = [np.unique(compact(pair_keys(shifted(ids, edge, START), ids), shards)) for ids, edge in token_runs(texts)]
    keys = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    return keys, shard_edges(keys, shards)


def block_counts(texts: pa.Array, train: pa.Array, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs and edges of block_pairs, and between them how often each pair occurs in the block's training texts."""
    parts, at, held = [np.zeros(0, np.uint64)], 0, ~train.to_numpy(zero_copy_only=False)
    for ids, edge in token_runs(texts):
        apart = np.repeat(held[at : at + len(edge) - 1], np.diff(edge)).astype(np.uint64)
        parts.append(compact(pair_keys(shifted(ids, edge, START), ids), shards) << np.uint64(1) | apart)
        at += len(edge) - 1
    coded, n = np.unique(np.concatenate(parts), return_counts=True)
    keys, counts = summed(coded >> np.uint64(1), np.where(coded & np.uint64(1), 0, n))
    return keys, counts, shard_edges(keys, shards)


def block_tokens(texts: pa.Array, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The different tokens of a block's texts by shard, sorted within it, and where each shard begins; the last edge is the end."""
    parts = [np.unique(ids) for ids, _ in token_runs(texts)]
    keys = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    at = shard_of(keys, shards)
    order = np.argsort(at, kind="stable")
    return keys[order], np.searchsorted(at[order], np.arange(shards + 1))


def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of a partition with the number of the block that they belong to: the rows' places decide, so a second reading of
    the same partition gives the same blocks."""
    done = 0
    for b in batches:
        n = pc.binary_length(b.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        number = (done + np.cumsum(n) - n) // BLOCK_BYTES
        done += int(n.sum())
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), b.num_rows]
        for i, k in zip(cuts[:-1], cuts[1:], strict=True):
            if i < k:
                yield int(number[i]), b.slice(i, k - i)


def asked_of_blocks(rows: DataFrame, shards: int, token_shards: int) -> DataFrame:
    """(block, shard, keys, counts): the different pairs of each block, by shard, and how often they occur in its training texts;
    and its different tokens, whose shards are given as -1 - shard.  Without shards of one kind, it isn't asked for.
    rows have their partition's number in part, and whether they are learned from in train."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def asked(block: int, texts: list[pa.Array], train: list[pa.Array]) -> pa.RecordBatch:
            at, raw, n = [], [], []
            if shards:
                keys, counts, edge = block_counts(pa.concat_arrays(texts), pa.concat_arrays(train), shards)
                at = [s for s in range(shards) if edge[s] < edge[s + 1]]
                raw = [pack_keys(keys[edge[s] : edge[s + 1]] & LOW) for s in at]
                n = [pack_counts(counts[edge[s] : edge[s + 1]]) for s in at]
            if token_shards:
                keys, edge = block_tokens(pa.concat_arrays(texts), token_shards)
                use = [s for s in range(token_shards) if edge[s] < edge[s + 1]]
                at += [-1 - s for s in use]
                raw += [keys[edge[s] : edge[s + 1]].astype("<u8").tobytes() for s in use]
                n += [None] * len(use)
            return pa.RecordBatch.from_arrays([pa.array([block] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array(raw, pa.binary()), pa.array(n, pa.binary())], ["block", "shard", "keys", "counts"])

        now, texts, train = None, [], []
        for number, b in blocked(batches):
            block = (b.column("part")[0].as_py() << 32) + number
            if texts and block != now:
                yield asked(now, texts, train)
                texts, train = [], []
            now = block
            texts.append(b.column("text"))
            train.append(b.column("train"))
        if texts:
            yield asked(now, texts, train)

    return rows.select("part", "text", "train").mapInArrow(run, "block long, shard int, keys binary, counts binary")


def in_blocks(rows: DataFrame) -> DataFrame:
    """(block, rows): the rows of each block as one compressed Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(block: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])

        now, held = None, []
        for number, b in blocked(batches):
            block = (b.column("part")[0].as_py() << 32) + number
            if held and block != now:
                yield given(now, held)
                held = []
            now = block
            held.append(b)
        if held:
            yield given(now, held)

    return rows.mapInArrow(run, "block long, rows binary")


ANSWERS = "block long, shard int, q binary, check long"


def answered(asked: pa.Table, filter_: np.ndarray) -> pa.Table:
    """(block, shard, q, check): levels of each block's pairs in the shard, in the order of block_pairs, a byte each, and a hash of
    the keys that were asked."""
    raw = asked.column("keys").to_pylist()
    q = []
    for x in raw:
        keys = all_keys(x)
        q.append(zlib.compress(probe(filter_, np.array([0, len(filter_)]), np.zeros(len(keys), np.int64), keys).astype(np.uint8).tobytes(), 1))
    return pa.table([asked.column("block"), asked.column("shard"), pa.array(q, pa.binary()), pa.array([xxhash.xxh32_intdigest(x) for x in raw], pa.int64())], ["block", "shard", "q", "check"])


def token_answers(asked: pa.Table, payload: bytes | None) -> pa.Table:
    """As answered: exact counts of each block's tokens in the shard, whose counts payload has, in the order of block_tokens."""
    keys, counts = unpack_tokens(payload) if payload is not None else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    raw, q = asked.column("keys").to_pylist(), []
    for x in raw:
        own = np.frombuffer(x, "<u8")
        at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
        q.append(pack_counts(np.where(keys[at] == own, counts[at], 0) if len(keys) else np.zeros(len(own), np.int64)))
    return pa.table([asked.column("block"), asked.column("shard"), pa.array(q, pa.binary()), pa.array([xxhash.xxh32_intdigest(x) for x in raw], pa.int64())], ["block", "shard", "q", "check"])


def looked_up(asked: DataFrame, model: Model) -> DataFrame:
    """The answers of the model's regions, or of those of the pairs that are asked, and of the counts of its tokens."""

    def answer(asked: pa.Table, region: pa.Table) -> pa.Table:
        bits = region.column("bits").to_pylist()
        if len(asked) and asked.column("shard")[0].as_py() < 0:
            return token_answers(asked, bits[0] if bits else None)
        return answered(asked, np.frombuffer(bits[0], np.uint8) if bits else np.zeros(0, np.uint8))

    def count_and_answer(asked: pa.Table, tokens: pa.Table) -> pa.Table:
        if not len(asked) or asked.column("shard")[0].as_py() < 0:
            return answer(asked, tokens)
        each = [all_keys(x) for x in asked.column("keys").to_pylist()]
        n = [unpack_counts(x, len(k)) for x, k in zip(asked.column("counts").to_pylist(), each, strict=True)]
        seen = [x > 0 for x in n]
        keys, counts = summed(np.concatenate([k[x] for k, x in zip(each, seen, strict=True)]), np.concatenate([k[x] for k, x in zip(n, seen, strict=True)]))
        return answered(asked, fill(keys, counts))

    tokens = model.tokens.withColumn("shard", -1 - F.col("shard"))
    if model.regions is None and model.filter is None:
        if model.keys is not None:
            return asked.groupBy("shard").applyInArrow(lambda t: count_and_answer(t, t.slice(0, 0)), ANSWERS)
        return asked.groupBy("shard").cogroup(tokens.groupBy("shard")).applyInArrow(count_and_answer, ANSWERS)
    known = tokens if model.filter is not None else model.regions if model.keys is not None else model.regions.unionByName(tokens)
    return asked.drop("counts").groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(answer, ANSWERS)


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    m = {"total": model.total, "distinct": model.distinct, "starts": model.starts, "shards": model.shards}
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), in_training().alias("train"))
    if (model.filter is None or model.keys is None) and "Exchange" in own._jdf.queryExecution().executedPlan().toString():
        own = cut(own)  # read twice, and what comes from a shuffle may come in another order

    def emit(ids: list, got: list) -> pa.RecordBatch:
        cols = [np.concatenate(x) for x in zip(*got, strict=True)] if got else [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([crc_bucket(i, MODULUS) == HELD for i in ids], pa.bool_()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    counts = spark.sparkContext.broadcast((model.keys, model.counts)) if model.keys is not None else None
    filter_ = spark.sparkContext.broadcast(model.filter) if model.filter is not None else None
    whole_levels = lambda keys: probe(*filter_.value, shard_of(keys, m["shards"]), keys)

    def counted(b: pa.RecordBatch, keys: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Runs with the tokens' counts, from sorted keys with counts."""
        for ids, edge in token_runs(b.column("text")):
            own_ids, back = np.unique(ids, return_inverse=True)
            at = np.minimum(np.searchsorted(keys, own_ids), max(len(keys) - 1, 0))
            c = np.where(keys[at] == own_ids, n[at], 0) if len(keys) else np.zeros(len(own_ids), np.int64)
            yield ids, edge, c[back]

    if counts is not None and filter_ is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield emit(b.column("doc_id").to_pylist(), [run_scores(*x, m, whole_levels) for x in counted(b, *counts.value)])

        out = own.mapInArrow(run, OUT)
    else:
        parted = own.withColumn("part", F.spark_partition_id().cast("long"))
        pair_shards, token_shards = 0 if filter_ is not None else model.shards, 0 if counts is not None else model.token_shards

        def met(answers: pa.Table, keys: np.ndarray, edge: np.ndarray, packed: Callable[[np.ndarray], bytes], read: Callable[[bytes, int], np.ndarray], sign: int) -> np.ndarray:
            """What the answers of one kind say of a block's keys."""
            got, n = np.zeros(len(keys), np.int64), 0
            for s, raw, check in zip(*(answers.column(c).to_pylist() for c in ("shard", "q", "check")), strict=True):
                if (s < 0) != (sign < 0):
                    continue
                i, k = (edge[x] for x in ((s, s + 1) if s >= 0 else (-1 - s, -s)))
                if check != xxhash.xxh32_intdigest(packed(keys[i:k])):
                    raise RuntimeError("the documents came in another order: checkpoint them first")
                got[i:k] = read(raw, k - i)
                n += k - i
            if n != len(keys):
                raise RuntimeError("the documents came in another order: checkpoint them first")
            return got

        def run_block(t: pa.Table, answers: pa.Table) -> pa.Table:
            if len(t) != 1:
                raise RuntimeError("the documents came in another order: checkpoint them first")
            own = pa.ipc.open_stream(t.column("rows")[0].as_buffer()).read_all().combine_chunks()
            texts, levels, known = own.column("text").combine_chunks(), whole_levels, counts.value if counts is not None else None
            if pair_shards:
                pairs, edge = block_pairs(texts, pair_shards)
                q = met(answers, pairs, edge, lambda x: pack_keys(x & LOW), lambda raw, n: np.frombuffer(zlib.decompress(raw), np.uint8, n), 1)
                levels = lambda own_keys: q[np.searchsorted(pairs, compact(own_keys, pair_shards))]
            if token_shards:
                tokens, edge = block_tokens(texts, token_shards)
                n = met(answers, tokens, edge, lambda x: x.astype("<u8").tobytes(), unpack_counts, -1)
                order = np.argsort(tokens)
                known = tokens[order], n[order]
            return pa.Table.from_batches([emit(b.column("doc_id").to_pylist(), [run_scores(*x, m, levels) for x in counted(b, *known)]) for b in own.to_batches()])

        answers = looked_up(asked_of_blocks(parted, pair_shards, token_shards), model)
        out = in_blocks(parted.drop("train")).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run_block, OUT)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def learned_scores(docs: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """score(docs, learn(docs)), with pairs shuffled once."""
    return score(docs, learn(docs, max_broadcast, pairs=False))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_scores(table(spark, sf_dir, "documents"))
