"""SentencePiece (BPE with byte fallback) encoding and decoding by vectorised merge rounds.

A text is cut where a marker U+2581 follows another character (no piece of the vocabulary reaches across, and the model
normalises nothing; the table checks both), and each different segment of a batch is encoded once.  All segments lie in one flat numpy symbol array.
A round looks up the rank of every adjacent pair, takes the least rank of each segment, merges the leftmost pair of
that rank, and compacts; segments without a pair leave the array.  Where a merged piece can't begin or end a pair of
better rank, all its pairs in a segment merge in the same round, leftmost first, which gives the same result.  Symbols
outside the vocabulary become the byte pieces of their UTF-8 form.  The library is not used for encoding or decoding.

Cases: null and empty texts give the begin and end ids alone and decode to the empty string; texts of any length are
encoded whole; columns other than the id and the text are not read by the query.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import lean, table

BOS, EOS, MARK = 1, 2, "▁"
SEGMENT = re.compile(f"{MARK}*[^{MARK}]*")
CACHE_SEGMENTS, CACHE_CHARS = 200_000, 64
#: Codes of characters in the symbol arrays: the code point above all piece ids.
CHAR = 1 << 20
NONE = np.int64(1) << 40


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary as arrays, read from a model file: pieces, byte pieces, and all pairs that merge, by rank."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        odd = "\uff21 \ufb01  a\t\u00a0e\u0301  "
        if sp.normalize(odd) != MARK + odd.replace(" ", MARK):
            raise ValueError("the model normalises texts; this encoder doesn't apply")
        n = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        special = np.array([sp.is_control(i) or sp.is_unknown(i) for i in range(n)])
        is_byte = np.array([sp.is_byte(i) for i in range(n)])
        self.byte_ids = np.full(256, -1, np.int64)
        for i in np.flatnonzero(is_byte):
            self.byte_ids[int(text[i][3:5], 16)] = i
        plain = {t: i for i, t in enumerate(text) if not special[i] and not is_byte[i]}
        if any(MARK in t.lstrip(MARK) for t in plain):
            raise ValueError("a piece reaches across a word boundary; this encoder doesn't apply")
        # equal scores are one rank: of those the leftmost pair goes first
        scores = np.array([sp.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        code = lambda t: plain[t] if t in plain else (CHAR + ord(t) if len(t) == 1 else -1)
        rows = []
        for t, i in plain.items():
            rows += [(a, b, i, rank[i]) for k in range(1, len(t)) if (a := code(t[:k])) >= 0 and (b := code(t[k:])) >= 0]
        pair = np.array(rows, np.int64).reshape(-1, 4)
        key = (pair[:, 0] << 21) | pair[:, 1]
        at = np.argsort(key, kind="stable")
        self.key, self.merged, self.rank = np.append(key[at], np.iinfo(np.int64).max), np.append(pair[at, 2], 0), np.append(pair[at, 3], NONE)
        # a merged piece is safe when no pair that it takes part in is of equal or better rank than itself
        best = np.full(n, NONE)
        for side in (0, 1):
            inside = pair[:, side] < n
            np.minimum.at(best, pair[inside, side], pair[inside, 3])
        self.safe = best > rank
        self.chars = {ord(t): i for t, i in plain.items() if len(t) == 1}
        raw = [b"" if special[i] else (bytes([int(t[3:5], 16)]) if is_byte[i] else t.replace(MARK, " ").encode()) for i, t in enumerate(text)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([len(x) for x in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.marks = {t.count(MARK): i for t, i in plain.items() if set(t) == {MARK}}
        self.longest_run = max(self.marks)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place in the pair table, or its last, which ranks below all."""
        k = (a << 21) | b
        at = np.searchsorted(self.key, k)
        return np.where(self.key[at] == k, at, len(self.key) - 1)

    def merge(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The flat ids of all segments, and how many each has."""
        lengths = np.array([len(s) for s in segments], np.int64)
        points = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32).astype(np.int64)
        seen, back = np.unique(points, return_inverse=True)
        sym = np.array([self.chars.get(int(c), CHAR + int(c)) for c in seen], np.int64)[back] if len(seen) else points
        seg = np.repeat(np.arange(len(segments)), lengths)
        done_sym, done_seg = [], []
        while len(sym) > 1:
            at = self.pairs(sym[:-1], sym[1:])
            rank = self.rank[at]
            rank[seg[:-1] != seg[1:]] = NONE
            first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            least = np.minimum.reduceat(np.append(rank, NONE), first)
            open_ = least < NONE
            counts = np.diff(np.append(first, len(sym)))
            least = np.repeat(np.where(open_, least, -1), counts)[:-1]
            hit = np.flatnonzero(rank == least)
            if not len(hit):
                break
            # of a safe piece all pairs merge that don't overlap one to their left, else the leftmost alone
            own = seg[hit]
            lead = np.r_[True, own[1:] != own[:-1]]
            run = np.r_[True, (hit[1:] != hit[:-1] + 1) | (at[hit[1:]] != at[hit[:-1]])]
            start = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            even = (np.arange(len(hit)) - start) % 2 == 0
            same = at[hit] == at[hit[np.maximum.accumulate(np.where(lead, np.arange(len(hit)), 0))]]
            take = hit[lead | (self.safe[self.merged[at[hit]]] & even & same)]
            sym[take] = self.merged[at[take]]
            keep = np.ones(len(sym), bool)
            keep[take + 1] = False
            live = np.repeat(open_, counts)
            gone = keep & ~live
            if gone.any():
                done_sym.append(sym[gone])
                done_seg.append(seg[gone])
            keep &= live
            sym, seg = sym[keep], seg[keep]
        sym, seg = np.concatenate([*done_sym, sym]), np.concatenate([*done_seg, seg])
        order = np.argsort(seg, kind="stable")
        sym, seg = sym[order], seg[order]
        odd = np.flatnonzero(sym >= CHAR)
        if len(odd):  # byte fallback
            raw = [chr(int(c) - CHAR).encode() for c in sym[odd]]
            width = np.ones(len(sym), np.int64)
            width[odd] = [len(x) for x in raw]
            put = np.repeat(sym, width)
            spot = np.repeat(np.cumsum(width)[odd] - width[odd], width[odd]) + np.concatenate([np.arange(len(x)) for x in raw])
            put[spot] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            sym, seg = put, np.repeat(seg, width)
        return sym, np.bincount(seg, minlength=len(segments))

    def segments(self, text: str) -> list[str]:
        """Runs of markers longer than any piece are parted from their front: there the longest piece repeats."""
        out = SEGMENT.findall(MARK + text.replace(" ", MARK))
        out.pop()  # the empty match at the end
        most = self.longest_run
        if MARK * (most + 2) in text.replace(" ", MARK) or len(text) > 0 and (MARK + text[: most + 2].replace(" ", MARK)).startswith(MARK * (most + 2)):
            parted = []
            for s in out:
                m = len(s) - len(s.lstrip(MARK))
                q = max(0, (m - 2) // most) if m > most + 1 else 0
                parted += [MARK * most] * q + [s[q * most :]]
            out = parted
        return out

    def encode(self, texts: list[str], cache: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids with begin and end, and the number of each text."""
        if len(cache) > CACHE_SEGMENTS:
            cache.clear()
        index: dict[str, int] = {}
        flat: list[int] = []
        counts = []
        for t in texts:
            own = self.segments(t) if t else []
            counts.append(len(own))
            flat += [index.setdefault(s, len(index)) for s in own]
        fresh = [s for s in index if s not in cache]
        if fresh:
            ids, n = self.merge(fresh)
            cut_at = np.cumsum(n)[:-1]
            new = dict(zip(fresh, np.split(ids.astype(np.uint32), cut_at), strict=True))
            cache.update((s, v) for s, v in new.items() if len(s) <= CACHE_CHARS)
        else:
            new = {}
        parts = [new[s] if s in new else cache[s] for s in index]
        size = np.array([len(p) for p in parts], np.int64)
        pool = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        begin = np.cumsum(size) - size
        which = np.array(flat, np.int64)
        per = size[which] if len(which) else np.zeros(0, np.int64)
        out = pool[gather(begin[which], per)] if len(which) else np.zeros(0, np.uint32)
        edge = np.concatenate([[0], np.cumsum(per)])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        n = np.diff(edge)
        full = np.empty(len(out) + 2 * len(texts), np.uint32)
        last = np.cumsum(n + 2)
        head = last - n - 2
        body = np.ones(len(full), bool)
        body[head] = body[last - 1] = False
        full[body], full[head], full[last - 1] = out, BOS, EOS
        return full, n + 2

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of the ids: pieces joined, bytes that form no character replaced, and the first marker's space left out."""
        size = self.size[ids]
        raw = self.raw[gather(self.start[ids], size)].tobytes()
        edge = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        out = []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            x = raw[a:b]
            out.append((x[1:] if x[:1] == b" " else x).decode("utf-8", "replace"))
        return out


def gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start[i] ... start[i] + size[i] - 1, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One table per worker process."""
    return Pieces(path)


#: Texts are taken in slices of about so many characters, which bounds the arrays.
SLICE_CHARS = 2_000_000


def slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    texts = batch.column(column).to_pylist()
    at, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= SLICE_CHARS or i == len(texts) - 1:
            yield batch.slice(at, i + 1 - at), [x or "" for x in texts[at : i + 1]]
            at, chars = i + 1, 0


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>, decoded string): the ids of each whole text, and what they decode to."""
    own = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = pieces(own), {}
        for b in batches:
            for part, texts in slices(b, "text"):
                ids, n = model.encode(texts, cache)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))), pa.array(model.decode(ids, n), pa.string())], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` as id", f"cast(`{text_col}` as string) as text").mapInArrow(lean(run), f"id {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; the ids are hashed where they are made."""
    own = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = pieces(own), {}
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            for part, texts in slices(b, "text"):
                ids, n = model.encode(texts, cache)
                edge = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array([sha(ids[a:z].astype("<u4").tobytes()) for a, z in zip(edge[:-1], edge[1:], strict=True)]), pa.array([sha(x.encode()) for x in model.decode(ids, n)])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
