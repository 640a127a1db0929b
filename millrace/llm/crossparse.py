"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over running text: whole labelled documents in the order of a hash of theirs, joined
up to SAMPLE_CHARS characters.  Texts are normalised alike: lower-cased runs of letters, one space around each.  A text is
parsed, against each automaton, into longest matches, which cross words freely; a character that the sample lacks is a
phrase of its own.  The language that needs fewest phrases per character wins (ties: the smaller name); phrases times the
logarithm of the sample, per character, estimate the cross entropy.  The score is the winner's margin over the
runner-up, 1 - phrases(winner) / phrases(next), brought to 0..1; with one learned language it is 1.

Texts are parsed in pieces of PIECE characters, at whose ends a phrase ends too; this adds the same bound for all languages, and
lets all pieces of many texts, in all languages, be parsed side by side in numpy.  The automata's transitions are one hash
table, made on the driver from at most TOTAL_CHARS characters, and broadcast.

Cases: a null text, and one without a letter, is 'und' with score 0; with nothing to learn from, every text is; null
languages and texts teach nothing; a text in no learned script ties, and gets the smallest name with score 0; prediction reads
the text alone, whole, at any length; extra columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import crc_bucket_col, cut, lean, table

#: Characters of text that a language is learned from, and all languages together, which bounds the broadcast; the first documents
#: in the order of a hash, so the same at any size.
SAMPLE_CHARS, TOTAL_CHARS = 50_000, 400_000
#: So many times that sample is drawn by hash before it is cut.
MARGIN = 4
MODULUS, HELD = 4, 2
#: Values of lang up to which their shares of the sample are broadcast; more are joined by a shuffle.
MOST_BROADCAST_LANGS = 10_000
PIECE = 512
#: Characters that are parsed at a time.
SLICE = 1 << 20
LETTERS = re.compile(r"[^\W\d_]+")


def normalised(text: str) -> str:
    """Lower-cased runs of letters with a space before, between and after; empty without a letter."""
    found = LETTERS.findall(text.lower())
    return f" {' '.join(found)} " if found else ""


class Automaton:
    """Suffix automaton of several segments; states are rows of transition dictionaries."""

    def __init__(self, segments: list[str]) -> None:
        nxt: list[dict[str, int]] = [{}]
        link, length = [-1], [0]
        for seg in segments:
            last = 0
            for c in seg:
                p = last
                if c in nxt[p] and length[nxt[p][c]] == length[p] + 1:
                    last = nxt[p][c]
                    continue
                clone_only = c in nxt[p]
                cur = -1
                if not clone_only:
                    cur = len(nxt)
                    nxt.append({})
                    link.append(0)
                    length.append(length[p] + 1)
                    while p >= 0 and c not in nxt[p]:
                        nxt[p][c] = cur
                        p = link[p]
                if p < 0:
                    last = cur
                    continue
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    to = q
                else:
                    to = len(nxt)
                    nxt.append(dict(nxt[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = to
                        p = link[p]
                    link[q] = to
                if cur >= 0:
                    link[cur] = to
                    last = cur
                else:
                    last = to
        self.next = nxt


class Model:
    """The automata of all languages as one hash table of transitions: (state, character) to state."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.names = sorted(samples)
        letters = sorted(set().union(*samples.values())) if samples else []
        self.width = len(letters) + 1  # 0 is any other character
        number = {c: i for i, c in enumerate(letters, 1)}
        self.known = np.array([ord(c) for c in letters], np.uint32)
        self.roots, base = [], 0
        keys, to = [], []
        self.first = np.full((self.width, len(self.names)), -1, np.int64)
        for at, name in enumerate(self.names):
            states = Automaton([samples[name]]).next
            self.roots.append(base)
            for state, moves in enumerate(states):
                for c, target in moves.items():
                    keys.append((base + state) * self.width + number[c])
                    to.append(base + target)
            for c, target in states[0].items():
                self.first[number[c], at] = base + target
            base += len(states)
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.table, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        left, value = np.array(keys, np.int64), np.array(to, np.int64)
        at = self.spot(left)
        while len(left):  # each free place takes one of those that want it; the others go on
            free = self.table[at] < 0
            self.table[at[free]] = left[free]
            won = self.table[at] == left
            self.to[at[won]] = value[won]
            left, value, at = left[~won], value[~won], (at[~won] + 1) & (1 << self.bits) - 1

    def spot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def moved(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The states after the characters, -1 where there is none."""
        keys = state * self.width + c
        at = self.spot(keys)
        met = self.table[at]
        out = np.where(met == keys, self.to[at], -1)
        again = np.flatnonzero((met != keys) & (met >= 0))
        while len(again):
            at[again] = (at[again] + 1) & (1 << self.bits) - 1
            met = self.table[at[again]]
            hit = met == keys[again]
            out[again[hit]] = self.to[at[again[hit]]]
            again = again[~hit & (met >= 0)]
        return out

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each normalised text in each language."""
        out = np.zeros((len(texts), len(self.names)), np.int64)
        held: list[str] = []
        whose: list[int] = []

        def done() -> None:
            if held:
                np.add.at(out, whose, self.parsed(held))
                held.clear()
                whose.clear()

        size = 0
        for i, t in enumerate(texts):
            for at in range(0, len(t), PIECE):
                held.append(t[at : at + PIECE])
                whose.append(i)
                size += PIECE
                if size >= SLICE:
                    done()
                    size = 0
        done()
        return out

    def parsed(self, pieces: list[str]) -> np.ndarray:
        """Phrases of each piece, of PIECE characters at most, in each language; all move on together, the longest first."""
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        sizes = np.array([len(pieces[i]) for i in order])
        code = np.frombuffer("".join(pieces[i] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32)
        near = np.minimum(np.searchsorted(self.known, code), len(self.known) - 1)
        c = np.where(self.known[near] == code, near + 1, 0)
        start, many = np.cumsum(sizes) - sizes, len(self.names)
        roots = np.tile(np.array(self.roots, np.int64), len(order))
        state, count = roots.copy(), np.zeros(len(roots), np.int64)
        alive = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left")  # pieces longer than t
        for t, m in enumerate(alive.tolist()):
            own = c[start[:m] + t]
            live = m * many
            after = self.moved(state[:live], np.repeat(own, many))
            lost = np.flatnonzero(after < 0)
            if len(lost):
                fresh = self.first[own[lost // many], lost % many]
                count[lost] += (state[lost] != roots[lost]).astype(np.int64) + (fresh < 0)
                after[lost] = np.where(fresh < 0, roots[lost], fresh)
            state[:live] = after
        count += state != roots
        out = np.zeros((len(pieces), many), np.int64)
        out[order] = count.reshape(-1, many)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, phrases per character) of each text."""
        norm = [normalised(t or "") for t in texts]
        if not self.names:
            return [("und", 0.0, 0.0)] * len(texts)
        n = self.phrases(norm)
        best = n.argmin(axis=1)
        if len(self.names) > 1:
            two = np.partition(n, 1, axis=1)
            score = 1.0 - two[:, 0] / np.maximum(two[:, 1], 1)
        else:
            score = np.ones(len(texts))
        rows = zip(norm, best.tolist(), score.tolist(), n.min(axis=1).tolist(), strict=True)
        return [(self.names[b], s, k / len(t)) if t else ("und", 0.0, 0.0) for t, b, s, k in rows]


def learn(docs: DataFrame) -> dict[str, str]:
    """The sample per language: of its documents that aren't held out, the first in the order of a hash, up to SAMPLE_CHARS
    normalised characters.  What reaches the driver is about languages * SAMPLE_CHARS characters."""
    own = docs.where("lang is not null and text is not null").where(crc_bucket_col(F.col("doc_id"), MODULUS) != HELD)
    keyed = own.select(F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("doc_id").cast("string"), F.lit(3)).alias("h"), F.col("text").cast("string").alias("text"))
    # so many of the hashes as hold some times the sample: only their texts are shuffled
    per = keyed.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"))
    share = cut(per.select("lang", F.least(F.lit(1.0), F.lit(float(MARGIN * SAMPLE_CHARS)) / F.greatest("chars", F.lit(1))).alias("share")))
    share = F.broadcast(share) if share.count() <= MOST_BROADCAST_LANGS else share  # else all texts would be shuffled to meet it
    drawn = keyed.join(share, "lang").where(F.col("h") <= F.col("share") * F.lit(2.0**64) - F.lit(2.0**63)).select("lang", "h", F.substring("text", 1, 2 * SAMPLE_CHARS).alias("text"))
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("h", "text").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = drawn.withColumn("before", before).where(F.col("before") < 2 * SAMPLE_CHARS).select("lang", "h", "text").collect()
    out: dict[str, str] = {}
    for lang, _, text in sorted(rows):
        out[lang] = (out.get(lang, "") + normalised(text))[:SAMPLE_CHARS]
    most = TOTAL_CHARS // max(len(out), 1)
    return {k: v[:most] for k, v in out.items() if v[:most]}


#: Texts that are parsed together have about so many characters, or are one text.
BATCH_CHARS = 4_000_000


def predicted(model: Model, texts: pa.Array) -> Iterator[tuple[int, list[tuple[str, float, float]]]]:
    """Runs of rows (where each begins) with their predictions."""
    held: list[str | None] = []
    at = size = 0
    for i, t in enumerate(texts):
        held.append(t.as_py())
        size += len(held[-1] or "")
        if size >= BATCH_CHARS or i == len(texts) - 1:
            yield at, model.predict(held)
            held, at, size = [], i + 1, 0


def predict(docs: DataFrame, sample: dict[str, str]) -> DataFrame:
    """doc_id, lang_pred, score, phrase_rate of the columns doc_id and text."""
    held = docs.sparkSession.sparkContext.broadcast(Model(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, got in predicted(held.value, b.column(1)):
                cols = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(got)), *[pa.array(x, k) for x, k in zip(cols, (pa.string(), pa.float64(), pa.float64()), strict=True)]], ["doc_id", "lang_pred", "score", "phrase_rate"])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(lean(run), "doc_id long, lang_pred string, score double, phrase_rate double")


def filter_documents(docs: DataFrame, langs: tuple[str, ...] | None = None, least_score: float = 0.005) -> DataFrame:
    """Documents in a learned language (or one of langs) with at least that margin, with all their own columns; those that no
    automaton knows better than another, such as texts of an unlearned script, stay unless langs are named."""
    held = docs.sparkSession.sparkContext.broadcast(Model(learn(docs)))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, got in predicted(held.value, b.column(at)):
                keep = [p != "und" and (p in langs if langs else s >= least_score or s == 0) for p, s, _ in got]
                yield b.slice(begin, len(got)).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, learn(docs))
    return out.select("doc_id", (crc_bucket_col(F.col("doc_id"), MODULUS) == HELD).alias("held_out"), "lang_pred", "score", "phrase_rate")
