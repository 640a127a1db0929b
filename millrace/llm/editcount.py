"""Edit-aware token counts.

A text is parted into pre-tokens of a byte-level BPE vocabulary.  Its tree has buckets of pre-tokens as leaves, each
with its text and token count, and sums of characters and tokens above.  An edit (place, characters to delete, text to
insert) descends by character sums to the buckets that it touches, takes in the next bucket with text where it touches an
edge, re-encodes those buckets alone, and updates the sums above them.  Buckets end only between a character that isn't
white space and one that is: there a pre-token always ends, so nothing outside the touched buckets can change.

Between runs the leaves are a table (doc_id, bucket, text, chars, tokens): leaf_table makes it, edit_leaves applies a table of
edits (doc_id, step, place, del, ins) to the documents that it names, encoding the touched buckets alone, and leaf_counts gives
the counts.

Cases: a null text is empty; places beyond the end act at the end, deletions end with the text; null edits and null
inserts do nothing; texts are never cut; extra columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table

#: White space as the vocabulary's pattern sees it (Python's own class has four control characters more).
WS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
CHUNK = re.compile(f" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
SPACE = re.compile(f"[{WS}]")
BUCKET, CACHE = 64, 500_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoding(path: str):  # noqa: ANN201
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter:
    """Tokens of a chunk, remembered; a chunk's pre-tokens do not depend on what surrounds it."""

    def __init__(self, path: str) -> None:
        self.enc, self.cache = encoding(path), {}

    def count(self, text: str) -> int:
        return sum(map(self.of, CHUNK.findall(text)))

    def of(self, chunk: str) -> int:
        n = self.cache.get(chunk)
        if n is None:
            n = len(self.enc.encode_ordinary(chunk))
            if len(chunk) <= 64:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[chunk] = n
        return n


class TokenTree:
    def __init__(self, text: str, counter: Counter) -> None:
        self.counter = counter
        self.encoded = 0
        self.build(self.leaves(text))

    @classmethod
    def of_leaves(cls, leaves: list[tuple[str, int]], counter: Counter) -> TokenTree:
        """The tree of stored leaves; nothing is encoded."""
        tree = cls("", counter)
        tree.build([x for x in leaves if x[0]])
        return tree

    def stored(self) -> list[tuple[str, int]]:
        return [(t, self.tokens[self.width + i]) for i, t in enumerate(self.text) if t]

    def leaves(self, text: str) -> list[tuple[str, int]]:
        """Buckets of about BUCKET pre-tokens, with their token counts."""
        self.encoded += len(text)
        of, out, own, n, held = self.counter.of, [], [], 0, 0
        for c in CHUNK.findall(text):
            if held >= BUCKET and own and not SPACE.match(own[-1][-1]) and SPACE.match(c[0]):
                out.append(("".join(own), n))
                own, n, held = [], 0, 0
            own.append(c)
            n += of(c)
            held += 1
        if own:
            out.append(("".join(own), n))
        return out

    def build(self, leaves: list[tuple[str, int]]) -> None:
        self.width = 1
        while self.width < len(leaves):
            self.width *= 2
        self.text = [t for t, _ in leaves] + [""] * (self.width - len(leaves))
        self.used = len(leaves)
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (t, n) in enumerate(leaves):
            self.chars[self.width + i], self.tokens[self.width + i] = len(t), n
        for i in range(self.width - 1, 0, -1):
            self.up(i)

    def up(self, i: int) -> None:
        self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, place: int) -> tuple[int, int]:
        """The bucket of a character and the place within; the end of the text is the last bucket's end."""
        if place >= self.chars[1]:
            last = max(self.used - 1, 0)
            return last, self.chars[self.width + last]
        i = 1
        while i < self.width:
            i *= 2
            if place >= self.chars[i]:
                place -= self.chars[i]
                i += 1
        return i - self.width, place

    def edit(self, place: int, delete: int, insert: str) -> None:
        total = self.chars[1]
        place = min(max(place, 0), total)
        stop = min(place + max(delete, 0), total)
        first, a = self.find(place)
        last, b = self.find(stop)
        before, after = "".join(self.text[first : first + 1])[:a], self.text[last][b:] if self.text else ""
        lo, hi = first, last
        while not before and lo > 0:  # the edit touches the edge: what it puts there may join the text before
            lo -= 1
            before = self.text[lo]
        while not after and hi + 1 < self.used:
            hi += 1
            after = self.text[hi]
        fresh = self.leaves(before + insert + after)
        if len(fresh) <= hi - lo + 1:
            fresh += [("", 0)] * (hi - lo + 1 - len(fresh))
        else:  # more buckets than before: the last takes the rest, until it is worth building anew
            room = hi - lo
            rest = fresh[room:]
            if len(rest) > 8:
                every = [(self.text[i], self.tokens[self.width + i]) for i in range(self.used)]
                self.build([x for x in every[:lo] + fresh + every[hi + 1 :] if x[0]])
                return
            fresh = fresh[:room] + [("".join(t for t, _ in rest), sum(n for _, n in rest))]
        touched = set()
        for i, (t, n) in enumerate(fresh, lo):
            if i >= self.width:
                break
            self.text[i], self.chars[self.width + i], self.tokens[self.width + i] = t, len(t), n
            touched.add((self.width + i) // 2)
        self.used = max(self.used, 1)
        while touched and 0 not in touched:
            for i in touched:
                self.up(i)
            touched = {i // 2 for i in touched}

    @property
    def total(self) -> int:
        return self.tokens[1]

    def whole(self) -> str:
        return "".join(self.text)


EDIT = "array<struct<place: bigint, del: bigint, ins: string>>"


def count_with_edits(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs(doc_id, text, edits): doc_id, n_tokens, n_tokens_edited, n_chars_edited, n_encoded: the counts before and after
    the edits, applied in order, and how many characters were encoded for the edits."""
    own = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(own)
        for b in batches:
            rows = []
            for text, edits in zip(b.column("text"), b.column("edits"), strict=True):
                tree = TokenTree(text.as_py() or "", counter)
                first, tree.encoded = tree.total, 0
                for e in edits.as_py() or ():
                    if e and e["place"] is not None:
                        tree.edit(e["place"], e["del"] or 0, e["ins"] or "")
                rows.append((first, tree.total, tree.chars[1], tree.encoded))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols]], ["doc_id", "n_tokens", "n_tokens_edited", "n_chars_edited", "n_encoded"])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text", f"cast(edits as {EDIT}) as edits").mapInArrow(
        run, "doc_id long, n_tokens long, n_tokens_edited long, n_chars_edited long, n_encoded long"
    )


LEAF = "doc_id long, bucket long, text string, chars long, tokens long"


def _leaf_batch(doc_id: int | None, leaves: list[tuple[str, int]]) -> pa.RecordBatch:
    t = [x for x, _ in leaves]
    return pa.RecordBatch.from_arrays(
        [pa.array([doc_id] * len(t), pa.int64()), pa.array(range(len(t)), pa.int64()), pa.array(t, pa.string()), pa.array([len(x) for x in t], pa.int64()), pa.array([n for _, n in leaves], pa.int64())],
        ["doc_id", "bucket", "text", "chars", "tokens"],
    )


def leaf_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The leaves of all documents; an empty text has one without text, so its document stays known."""
    own = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(own)
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                yield _leaf_batch(doc_id, TokenTree(text.as_py() or "", counter).stored() or [("", 0)])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(run, LEAF)


def edit_leaves(leaves: DataFrame, edits: DataFrame, path: str | None = None) -> DataFrame:
    """The leaves after the edits (doc_id, step, place, del, ins), those of a document in the order of step.  Documents without
    edits keep their rows; edits of unknown documents do nothing.  Ids are taken to be different and not null here."""
    own = path or vocabulary_path()
    edits = edits.where("doc_id is not null and place is not null").selectExpr("cast(doc_id as bigint) as doc_id", "cast(step as bigint) as step", "cast(place as bigint) as place", "cast(del as bigint) as del", "cast(ins as string) as ins")
    named = edits.select("doc_id").distinct()

    def run(leaves: pa.Table, edits: pa.Table) -> pa.Table:
        counter = _counter(own)
        if not len(leaves):
            return _leaf_table([])
        rows = sorted(zip(leaves.column("bucket").to_pylist(), leaves.column("text").to_pylist(), leaves.column("tokens").to_pylist(), strict=True))
        tree = TokenTree.of_leaves([(t, n) for _, t, n in rows], counter)
        for e in sorted(edits.to_pylist(), key=lambda e: e["step"] or 0):
            tree.edit(e["place"], e["del"] or 0, e["ins"] or "")
        return _leaf_table([_leaf_batch(leaves.column("doc_id")[0].as_py(), tree.stored() or [("", 0)])])

    changed = leaves.join(named, "doc_id", "left_semi").groupBy("doc_id").cogroup(edits.groupBy("doc_id")).applyInArrow(run, LEAF)
    return leaves.join(named, "doc_id", "left_anti").select(*changed.columns).union(changed)


def _leaf_table(batches: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(batches or [_leaf_batch(None, [])])


@lru_cache(maxsize=1)
def _counter(path: str) -> Counter:
    return Counter(path)


def leaf_counts(leaves: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_chars: the sums, of which the map side makes one row a document and task."""
    return leaves.groupBy("doc_id").agg(F.sum("tokens").alias("n_tokens"), F.sum("chars").alias("n_chars"))


#: Three edits per document: an insertion, a replacement and a deletion at places that follow from the id.
INSERTS = (" a corrected phrase,", "\n\n", "")


def standard_edits(doc_id: Column, text: Column) -> Column:
    n = F.length(F.coalesce(text, F.lit(""))).cast("long") + 1
    spot = lambda i: F.pmod(F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{i}")).cast("binary")), n)
    return F.array(*[F.struct(spot(i).alias("place"), F.lit(7 * i).cast("long").alias("del"), F.lit(s).alias("ins")) for i, s in enumerate(INSERTS)])


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return count_with_edits(docs.select("doc_id", "text", standard_edits(F.col("doc_id"), F.col("text")).alias("edits")))
