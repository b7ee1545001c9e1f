"""Chat formatting by token-level assembly.

Each turn becomes ``<|im_start|>role\\ncontent<|im_end|>\\n``. Role and content are encoded each for itself as
ordinary text; the control tokens are reserved ids spliced between the encoded segments, so no text can make
one. In the written form the same strings stand for them, and so a text's own ``<|`` is escaped: one backslash
is put into every ``<``, backslashes, ``|``; taking one out of every ``<``, one or more backslashes, ``|``
gives the text back.

Ids below ``START`` are the vocabulary's. The loss mask is given as spans, from prefix sums of the segments'
lengths: (offset, length) of an assistant's content within its conversation's ids. Offsets of turns within a
conversation are prefix sums over its turns.

Order: turns by turn number, then role and digest of the text (for ties); nulls first. Nulls: a null text or role is
empty; rows with a null conversation are one conversation of their own. Repeated rows are repeated turns.
Other columns are ignored; an empty table gives no rows. A conversation of any number of turns is streamed
in order through a task, which holds the digests of one conversation and no list of turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pantry.llm import text as T
from pantry.llm import vocab

IM_START, IM_END = "<|im_start|>", "<|im_end|>"
START, END = 60000, 60001  # reserved: above every id of the vocabularies in use
LOSS_ROLE = "assistant"
_CONTROL, _MORE = r"<(\\*)\|", r"<\\\1|"
_BACK = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return re.sub(_CONTROL, _MORE, text) if "<" in text else text


def escaped(texts: pa.Array) -> pa.Array:
    """The same for a column."""
    return pc.replace_substring_regex(texts.cast(pa.large_string()), _CONTROL, _MORE)


def unescape(text: str) -> str:
    return _BACK.sub(r"<\1|", text) if "<" in text else text


def formatted(turns: DataFrame, vocabulary: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, n_ids, ids (binary, unsigned 32-bit), loss_from, loss_ids, offset: a row a turn.

    loss_from counts from the turn's first id; offset is the number of ids of the conversation before the turn.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocab.encoder(vocabulary)
        if encoder.model.get_vocab_size() > START:
            raise ValueError("the vocabulary has the reserved ids itself")
        tail, _ = encoder.encode(*T.view(pa.array(["\n"])))
        newline, nothing = pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())
        for batch in batches:
            for part in T.slices(batch):
                n = part.num_rows
                head, head_ranges = encoder.encode(*T.view(pc.binary_join_element_wise(escaped(part.column("role")), newline, nothing)))
                body, body_ranges = encoder.encode(*T.view(escaped(part.column("text"))))
                h, b = np.diff(head_ranges), np.diff(body_ranges)
                sizes = np.stack([np.ones(n, np.int64), h, b, np.ones(n, np.int64), np.full(n, len(tail))], 1)
                place = np.concatenate(([0], np.cumsum(sizes)))[:-1].reshape(n, 5)  # prefix sums over all segments
                ranges = np.append(place[:, 0], sizes.sum())
                out = np.empty(int(sizes.sum()), np.uint32)
                out[place[:, 0]] = START
                out[T.ragged(place[:, 1], h)] = head
                out[T.ragged(place[:, 2], b)] = body
                out[place[:, 3]] = END
                out[T.ragged(place[:, 4], sizes[:, 4])] = np.tile(tail, n)
                loss = pc.equal(part.column("role"), LOSS_ROLE).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), part.column("turn"), part.column("role"), part.column("h"), pa.array(np.diff(ranges)), T.blobs(out, ranges), pa.array(place[:, 2] - place[:, 0]), pa.array(np.where(loss, b, 0))],
                    ["conv_id", "turn", "role", "h", "n_ids", "ids", "loss_from", "loss_ids"],
                )

    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.sha2("text", 256))  # for ties: an order of texts that costs no long keys in the sort
    done = rows.mapInArrow(encode, "conv_id long, turn long, role string, h string, n_ids long, ids binary, loss_from long, loss_ids long")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "h")
    before = F.coalesce(F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return done.withColumn("offset", before)


class _Digest:
    """What is read back of one conversation, fed turn by turn."""

    def __init__(self, conv: int | None):
        self.conv, self.n_turns, self.loss_chars, self.formatted_chars = conv, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, written: str, tail: str, masked: str) -> None:
        role, _, body = written.partition("\n")
        self.n_turns += 1
        self.formatted_chars += len(IM_START) + len(written) + len(IM_END) + len(tail)
        self.turns.update(f"{unescape(role)}\n{unescape(body)}\n".encode())
        if masked:
            own = unescape(masked)
            self.loss_chars += len(own)
            self.loss.update(own.encode())


def _turns(encoder: vocab.UnitEncoder, part: pa.RecordBatch) -> Iterator[tuple[str, str, str, int]]:
    """What stands between the control tokens of each turn, behind them and under its loss mask, and its number of ids."""
    column = part.column("ids").cast(pa.large_binary())
    ranges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 4
    ids = np.frombuffer(column.buffers()[2], np.uint32)[ranges[0] : ranges[-1]]
    ranges = ranges - ranges[0]
    ends = np.flatnonzero(ids == END)
    if not np.array_equal(np.flatnonzero(ids == START), ranges[:-1]) or not np.array_equal(np.searchsorted(ends, ranges), np.arange(len(ranges))):
        raise ValueError("a turn is not framed by its control tokens")
    ordinary = np.ones(len(ids), bool)
    ordinary[ranges[:-1]] = ordinary[ends] = False
    data, own = encoder.decode(ids[ordinary])
    at = own[np.concatenate(([0], np.cumsum(ordinary)))]  # the byte at which each id begins
    loss = ranges[:-1] + part.column("loss_from").to_numpy()
    bounds = np.stack([at[ranges[:-1] + 1], at[ends], at[ends + 1], at[ranges[1:]], at[loss], at[loss + part.column("loss_ids").to_numpy()]], 1)
    for (a, b, c, d, e, f), n in zip(bounds.tolist(), np.diff(ranges).tolist()):
        yield data[a:b].decode(), data[c:d].decode(), data[e:f].decode(), n


def read_back(assembled: DataFrame, vocabulary: str) -> DataFrame:
    """One row a conversation from its ids: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocab.encoder(vocabulary)
        now, n_ids, done = None, 0, []

        def row() -> tuple:
            return (now.conv, now.n_turns, now.turns.hexdigest(), now.loss_chars, now.loss.hexdigest(), now.formatted_chars, n_ids)

        def flush() -> pa.RecordBatch:
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_ids"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            for part in T.slices(batch, "ids", 4 * T.CHUNK_BYTES):
                for conv, (written, tail, masked, n) in zip(part.column("conv_id").to_pylist(), _turns(encoder, part)):
                    if now is None or now.conv != conv:
                        if now is not None:
                            done.append(row())
                        now, n_ids = _Digest(conv), 0
                    now.add(written, tail, masked)
                    n_ids += n
            if done:
                yield flush()
                done.clear()
        if now is not None:
            done.append(row())
            yield flush()

    dealt = assembled.repartition("conv_id").sortWithinPartitions("conv_id", "offset")
    return dealt.select("conv_id", "ids", "loss_from", "loss_ids").mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_ids long")
