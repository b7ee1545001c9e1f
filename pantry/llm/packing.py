"""Packing by concatenation and cutting.

Pass 1 encodes every document once and writes its ids to the shared folder with the task's number and the
ids before it in that task. The tasks' totals (a row each) are summed in task order into bases, so each
document has its place in one endless stream of ids. Pass 2 cuts the stream every ``window`` ids. A window
all of whose pieces a task meets together is a sequence at once; the pieces at a stretch's two ends are the boundary
records, shuffled by sequence number and joined there. Sequences are written, and pieces are read back from them. Only the last sequence of all can need padding: it is padded
to ``window`` unless its length is a power of two.

Nulls: a null text is an empty document, which still has its end id; a null document key is kept. Rows
with the same key are packed each for itself. Other columns are ignored. An empty table gives no pieces.
Memory: a task holds one chunk of text or the longest single document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantry.llm import text as T
from pantry.llm import vocab
from pantry.llm.shared import kept


def encoded(docs: DataFrame, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text", drop_white: bool = True) -> DataFrame:
    """key, task, before (ids before the document in its task), n_ids, ids (unsigned 16- or 32-bit by ``width``)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, before, encoder = TaskContext.get().partitionId(), 0, vocab.encoder(vocabulary, drop_white)
        for batch in batches:
            for part in T.slices(batch, "text"):
                ids, ranges = encoder.encode(*T.view(part.column("text")), end_id)
                width = 2 if not len(ids) or ids.max() < 65536 else 4
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(np.full(n, task, np.int32)), pa.array(before + ranges[:-1]), pa.array(np.diff(ranges)), pa.array(np.full(n, width, np.int32)), T.blobs(ids.astype(np.uint16 if width == 2 else np.uint32), ranges)], ["key", "task", "before", "n_ids", "width", "ids"])
                before += len(ids)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return kept(rows.mapInArrow(encode, "key long, task int, before long, n_ids long, width int, ids binary"), "encoded")


def bases(stream: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(task, ids before it): the only thing that goes to the driver, a number a task."""
    totals = sorted(tuple(r) for r in stream.groupBy("task").agg(F.sum("n_ids")).collect())
    return np.array([t for t, _ in totals], np.int64), np.array([0, *accumulate(n for _, n in totals)][: len(totals)], np.int64)


_PIECE = pa.struct([("offset", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64())])
_CUT = pa.schema([("sequence_id", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.binary()), ("pieces", pa.list_(_PIECE)), ("whole", pa.bool_())])


def sequences(stream: DataFrame, window: int = 4096, pad_id: int = 0) -> DataFrame:
    """One row a sequence, written once: sequence_id, n_ids, ids (binary, unsigned 32-bit, padded) and its pieces (offset, key, start, length, doc_tokens).

    stream: as ``encoded`` gives it. A sequence has at most ``window`` pieces, so no group is larger than that.
    """
    tasks, before = bases(stream)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "ids"):
                place = before[np.searchsorted(tasks, part.column("task").to_numpy())] + part.column("before").to_numpy()
                order = np.argsort(place, kind="stable")
                part, place = part.take(pa.array(order)), place[order]
                lengths = part.column("n_ids").to_numpy()
                flat = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16 if w == 2 else np.uint32).astype("<u4") for x, w in zip(part.column("ids"), part.column("width").to_pylist())])
                own = np.cumsum(lengths) - lengths
                n_pieces = (place + lengths - 1) // window - place // window + 1
                row = np.repeat(np.arange(len(lengths)), n_pieces)
                sequence = np.repeat(place // window, n_pieces) + np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                at = np.maximum(sequence * window, place[row])
                end = np.minimum((sequence + 1) * window, (place + lengths)[row])
                edge = np.flatnonzero(np.concatenate(([True], (sequence[1:] != sequence[:-1]) | (at[1:] != end[:-1]))))
                size = np.diff(np.append(edge, len(row)))  # pieces of each run; they follow each other without a gap
                n_ids = np.add.reduceat(end - at, edge)
                first = (own[row] + at - place[row])[edge]
                fields = [at - sequence * window, part.column("key").take(pa.array(row)), at - place[row], end - at, lengths[row]]
                pieces = pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in fields], fields=list(_PIECE))
                lists = pa.ListArray.from_arrays(pa.array(np.append(edge, len(row)).astype(np.int32)), pieces)
                yield pa.RecordBatch.from_arrays([pa.array(sequence[edge]), pa.array(n_ids), pa.array([flat[a : a + n].tobytes() for a, n in zip(first.tolist(), n_ids.tolist())], pa.binary()), lists, pa.array(n_ids == window)], schema=_CUT)

    made = "sequence_id long, n_ids long, ids binary, pieces array<struct<offset: long, key: long, start: long, length: long, doc_tokens: long>>"
    runs = kept(stream.mapInArrow(cut, made + ", whole boolean"), "runs")
    edges = runs.where("not whole").select("sequence_id", F.struct(F.col("pieces")[0]["offset"].alias("offset"), "n_ids", "ids", "pieces").alias("run"))
    joined = edges.groupBy("sequence_id").agg(F.sort_array(F.collect_list("run")).alias("runs"))
    ids = F.aggregate("runs", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    n = F.aggregate("runs", F.lit(0).cast("long"), lambda a, x: a + x["n_ids"])
    joined = joined.select("sequence_id", n.alias("n_ids"), ids.alias("ids"), F.flatten(F.col("runs.pieces")).alias("pieces"))
    room = F.when(F.col("n_ids").bitwiseAND(F.col("n_ids") - 1) == 0, F.lit(0)).otherwise(F.lit(window) - F.col("n_ids"))
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), room.cast("int")))
    joined = joined.withColumn("ids", F.concat("ids", pad))
    return runs.where("whole").drop("whole").unionByName(kept(joined, "joined"))


def pieces(packed: DataFrame) -> DataFrame:
    """One row a piece, read back from the sequences: key, start, length, doc_tokens, sequence_id, offset, ids_crc32 (of its ids as unsigned 32-bit)."""

    each = packed.select("sequence_id", "ids", F.explode("pieces").alias("p"))
    ids = F.expr("substring(ids, int(4 * p.offset + 1), int(4 * p.length))")
    return each.select("p.key", "p.start", "p.length", "p.doc_tokens", "sequence_id", "p.offset", F.crc32(ids).alias("ids_crc32"))


def padded_length(n: int, window: int = 4096) -> int:
    """The stored length of a sequence of n ids."""
    return n if n & (n - 1) == 0 else window
