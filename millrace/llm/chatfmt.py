"""Chat formatting by columnar byte assembly, and its exact inverse.

A turn is written as a header that names its role, its text, and '</s>'; a conversation begins with '<s>'.  Headers:
'[INST] ' for user, ' [/INST] ' for assistant, '[SYS] ' for system, and '[ROLE=name] ' for any other role.  In texts
and role names each of the characters < [ and \\ is followed by a backslash, so no control string can occur inside
them, and taking that backslash out again restores them exactly.

Assembly: for a batch of turns the lengths of all segments are computed, cumulative offsets give each byte its place,
and headers and contents are scattered into one preallocated buffer, which becomes the Arrow column without a copy.
The loss mask is the list of byte ranges of assistant texts.

Rows are dealt by conversation and sorted by (turn, role, text), nulls first, and formatted as a stream: a task holds
one batch and the conversation at its end.  One whose texts pass PART_BYTES goes on as further parts, whose bytes follow on
one another, so no value grows with a conversation; digest takes the parts in turn and holds one.  A conversation is one
task's work, since its digests are those of one sequence of bytes.

Cases: a null text is empty; a null role is the role ''; rows of null conv_id belong to no conversation, and each is formatted
as one of its own, dealt like any other; repeated turns all count, in the order above; an empty table gives no rows; other
columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table

HEAD = {"user": b"[INST] ", "assistant": b" [/INST] ", "system": b"[SYS] "}
BEGIN, END = b"<s>", b"</s>"
ESCAPED = np.zeros(256, bool)
ESCAPED[[60, 91, 92]] = True
UNESCAPE = re.compile(rb"([<\[\\])\\")
TURN = re.compile(rb"(\[INST\] | \[/INST\] |\[SYS\] |\[ROLE=((?:[<\[\\]\\|\\\)|[^<\[\\\]])*)\] )((?:[<\[\\]\\|[^<\[\\])*)</s>", re.S)
ROLE_OF = {v: k for k, v in HEAD.items()}


def escape(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat bytes and offsets of the texts with a backslash after each escaped byte."""
    special = ESCAPED[raw]
    shift = np.cumsum(special)
    out = np.full(len(raw) + int(special.sum()), 92, np.uint8)
    before = shift - special
    out[np.arange(len(raw)) + before] = raw
    return out, offsets + np.concatenate([[0], shift])[offsets]


def places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    a = pa.array(texts, pa.large_binary()) if not isinstance(texts, pa.Array) else texts
    a = a.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]] if len(a) else np.zeros(0, np.uint8), off - off[0]


def assemble(firsts: np.ndarray, roles: list[str | None], texts: pa.Array, goes_on: bool = False) -> tuple[pa.Array, list[list[dict[str, int]]]]:
    """The formatted conversations of a batch whose turns lie in order; firsts: the rows that begin a conversation, of which the
    first one only goes on with goes_on."""
    n = len(roles)
    body, at = escape(*text_buffers(texts))
    names = [r or "" for r in roles]
    kinds = {r: HEAD[r] if r in HEAD else b"[ROLE=" + escape_role(r) + b"] " for r in set(names)}
    begins = np.zeros(n, bool)
    begins[firsts] = True
    head = [(BEGIN if b and (i or not goes_on) else b"") + kinds[r] for i, (r, b) in enumerate(zip(names, begins, strict=True))]
    head_raw = np.frombuffer(b"".join(head), np.uint8)
    head_size = np.array([len(h) for h in head], np.int64)
    size = np.diff(at)
    total = head_size + size + len(END)
    start = np.cumsum(total) - total
    out = np.empty(int(total.sum()), np.uint8)
    out[places(start, head_size)] = head_raw
    out[places(start + head_size, size)] = body
    out[places(start + head_size + size, np.full(n, len(END)))] = np.tile(np.frombuffer(END, np.uint8), n)
    edge = np.append(start, len(out))
    conv = np.append(edge[firsts], len(out)).astype(np.int64)
    col = pa.Array.from_buffers(pa.large_binary(), len(firsts), [None, pa.py_buffer(conv), pa.py_buffer(out)])
    masks: list[list[dict[str, int]]] = [[] for _ in firsts]
    which = np.cumsum(begins) - 1
    for i in np.flatnonzero(np.array([r == "assistant" for r in names], bool)):
        a = int(start[i] + head_size[i] - conv[which[i]])
        masks[which[i]].append({"start": a, "stop": a + int(size[i])})
    return col, masks


def escape_role(role: str) -> bytes:
    """As in texts; a closing bracket, which would end the header, is written as the escape pair backslash, parenthesis."""
    return re.sub(r"[<\[\\]", lambda m: m[0] + "\\", role).replace("]", "\\)").encode()


def unescape_role(raw: bytes) -> str:
    return re.sub(rb"([<\[\\])\\|\\\)", lambda m: m[1] or b"]", raw).decode()


def turns(formatted: bytes, part: int = 0) -> list[tuple[str, str]]:
    """The roles and texts of a formatted conversation, or a part of one: the inverse of assemble."""
    begin = b"" if part else BEGIN
    if formatted[: len(begin)] != begin:
        raise ValueError("not a formatted conversation")
    out, at = [], len(begin)
    for m in TURN.finditer(formatted, at):
        if m.start() != at:
            break
        at = m.end()
        role = ROLE_OF[m[1]] if m[1] in ROLE_OF else unescape_role(m[2])
        out.append((role, UNESCAPE.sub(rb"\1", m[3]).decode()))
    if at != len(formatted):
        raise ValueError("a formatted conversation that doesn't parse")
    return out


#: Bytes of a conversation's texts that are held before a part of it is given.
PART_BYTES = 16 << 20


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, formatted binary, loss_mask array<struct<start, stop>>): a row per conversation, part 0; a very long one
    has more, in order, with masks that count from each part's begin."""
    own = conversations.selectExpr("cast(conv_id as bigint) as conv_id", "cast(turn as bigint) as turn", "cast(role as string) as role", "cast(text as string) as text")
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())  # rows of no conversation are no hot key
    own = own.withColumn("alone", alone).repartition("conv_id", "alone").sortWithinPartitions("conv_id", "turn", "role", "text").drop("alone")

    def emit(held: list[pa.RecordBatch], part: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        ids = t.column("conv_id").to_pylist()
        firsts = np.array([i for i in range(len(ids)) if i == 0 or ids[i] is None or ids[i] != ids[i - 1]], np.int64)
        col, masks = assemble(firsts, t.column("role").to_pylist(), t.column("text").combine_chunks(), part > 0)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        parts = [part] + [0] * (len(firsts) - 1)
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in firsts], pa.int64()), pa.array(parts, pa.int32()), col.cast(pa.binary()), pa.array(masks, kind)], ["conv_id", "part", "formatted", "loss_mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the conversation at the end of what came
        now: int | None = None
        part = size = 0
        for b in batches:
            if not b.num_rows:
                continue
            b = b.select(["conv_id", "role", "text"])
            ids = b.column("conv_id").to_pylist()
            k = len(ids)
            while k and ids[-1] is not None and ids[k - 1] == ids[-1]:
                k -= 1
            if now is not None:  # one is open: rows of it are held, or parts of it were given
                own = next((i for i, x in enumerate(ids) if x != now), len(ids))
                if own < len(ids):
                    if held or own:
                        yield emit([*held, b.slice(0, own)], part)
                    held, part, size, now, b, k = [], 0, 0, None, b.slice(own), k - own
            if k:
                yield emit([b.slice(0, k)], 0)
            if k < b.num_rows:
                rest = b.slice(k)
                held, size, now = [*held, rest], size + rest.nbytes, ids[-1]
                if size > PART_BYTES:
                    yield emit(held, part)
                    held, part, size = [], part + 1, 0
        if held:
            yield emit(held, part)

    return own.mapInArrow(run, "conv_id long, part int, formatted binary, loss_mask array<struct<start: bigint, stop: bigint>>")


class Digest:
    """What the parts of a conversation hold, so far."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.n_turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def take(self, raw: bytes, part: int, mask: list[dict[str, int]]) -> None:
        for role, text in turns(raw, part):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for m in mask:
            own = UNESCAPE.sub(rb"\1", raw[m["start"] : m["stop"]])
            self.loss.update(own)
            self.loss_chars += len(own.decode())
        self.chars += len(raw.decode())

    def row(self) -> tuple:
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them; their parts must lie in order, as they are given."""
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Digest | None = None
        for b in batches:
            rows = []
            for conv_id, part, raw, mask in zip(*(b.column(c) for c in ("conv_id", "part", "formatted", "loss_mask")), strict=True):
                if part.as_py() == 0:
                    rows += [now.row()] if now else []
                    now = Digest(conv_id.as_py())
                now.take(raw.as_py(), part.as_py(), mask.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(now.row(), kinds, strict=True)], names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    return digest(format_conversations(own.unionByName(more)))
