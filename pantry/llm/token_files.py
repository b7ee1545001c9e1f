"""Flat token-id files with 64-bit document offsets, memory-mapped on reading.

Format of a shard (little-endian): ``shard-NNNNN.ids`` holds the ids of its documents back to back as
unsigned 16-bit integers (32-bit if the vocabulary has more than 65,536 ids); ``shard-NNNNN.idx`` holds a
header of five unsigned 64-bit integers (MAGIC, bytes per id, documents, ids, documents without a key), then the documents' keys
as signed 64-bit integers, then documents + 1 unsigned 64-bit offsets counted in ids within the shard.
The base of a shard in the whole corpus is the sum of the totals of all shards before it.

Documents are dealt to shards by ranges of their key, so shards in order hold ascending keys. Only one
row a shard (its totals) reaches the driver. A file gets its name only when it is whole, so a task that
is run again or twice leaves the same files.

Nulls: a null text is an empty document (its end id alone); null keys come before all others, and the header says how
many of them a shard has. The width of an id follows from the vocabulary's size; an id beyond it is an error. Rows with the same key are kept and ordered by text. Other columns are ignored. An
empty table gives no shards and an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pantry.llm import text as T
from pantry.llm import vocab
from pantry.llm.shared import shared_folder

MAGIC = 0x32534449544E5450
NULL_KEY = -(1 << 63)


def _store(folder: str):
    """The file system of a shared folder's URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _uri(folder: str) -> str:
    return "file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder


def write_shards(docs: DataFrame, folder: str, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text", n_ids: int | None = None) -> list[tuple[int, int, int]]:
    """Encode all documents and write the shards; returns (shard, documents, ids) of each, in order. n_ids: how many ids there are, else the vocabulary says."""
    n_ids = max(n_ids or vocab.encoder(vocabulary).model.get_vocab_size(), end_id + 1)
    folder, kind = _uri(folder), np.uint16 if n_ids <= 65536 else np.uint32

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encoder, n_docs, total, n_null = TaskContext.get().partitionId(), None, 0, 0, 0
        keys, lengths = [], []
        store, path = _store(folder)
        mark = f"{path}/.{TaskContext.get().taskAttemptId()}"
        out = None
        for batch in batches:
            for part in T.slices(batch, "text"):
                if out is None:
                    store.create_dir(path, recursive=True)
                    encoder, out = vocab.encoder(vocabulary), store.open_output_stream(f"{mark}.ids")
                ids, ranges = encoder.encode(*T.view(part.column("text")), end_id)
                if len(ids) and int(ids.max()) >= n_ids:
                    raise ValueError(f"id {int(ids.max())} is beyond the vocabulary's {n_ids}")
                out.write(ids.astype(kind).tobytes())
                n_null += int(np.count_nonzero(part.column("no_key").to_numpy(zero_copy_only=False)))
                keys.append(part.column("key").to_numpy(zero_copy_only=False).astype(np.int64))
                lengths.append(np.diff(ranges))
                n_docs, total = n_docs + part.num_rows, total + len(ids)
        if out is None:
            return
        out.close()
        with store.open_output_stream(f"{mark}.idx") as index:
            index.write(np.array([MAGIC, kind().itemsize, n_docs, total, n_null], "<u8").tobytes())
            index.write(np.concatenate(keys).astype("<i8").tobytes())
            index.write(np.concatenate(([0], np.cumsum(np.concatenate(lengths)))).astype("<u8").tobytes())
        for end in ("ids", "idx"):
            store.move(f"{mark}.{end}", f"{path}/shard-{shard:05d}.{end}")
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [n_docs], "n_ids": [total]})

    own = F.col(key).cast("long")
    rows = docs.select(F.coalesce(own, F.lit(NULL_KEY)).alias("key"), own.isNull().alias("no_key"), F.col(text).cast("string").alias("text"))
    dealt = rows.repartitionByRange("key").sortWithinPartitions("key", F.desc("no_key"), "text")
    return sorted(tuple(r) for r in dealt.mapInArrow(write, "shard long, n_docs long, n_ids long").collect())


def open_shard(folder: str, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(keys, offsets, ids, how many of the first keys are null) of a shard; mapped into memory where the folder is local, else read."""
    store, path = _store(_uri(folder))
    from pyarrow import fs

    local = isinstance(store, fs.LocalFileSystem)

    def get(name: str) -> np.ndarray:
        if local:
            return np.memmap(name, np.uint8, "r") if os.path.getsize(name) else np.zeros(0, np.uint8)
        with store.open_input_file(name) as f:
            return np.frombuffer(f.read_buffer(), np.uint8)

    index = get(f"{path}/shard-{shard:05d}.idx")
    magic, width, n_docs, total, n_null = index[:40].view("<u8").tolist()
    if magic != MAGIC:
        raise ValueError(f"not a token index: {path}/shard-{shard:05d}.idx")
    keys = index[40 : 40 + 8 * n_docs].view("<i8")
    offsets = index[40 + 8 * n_docs :].view("<u8")
    ids = get(f"{path}/shard-{shard:05d}.ids").view({2: "<u2", 4: "<u4"}[width])
    if len(offsets) != n_docs + 1 or len(ids) != total:
        raise ValueError(f"a token shard is cut short: {path}/shard-{shard:05d}")
    return keys, offsets, ids, n_null


def read_documents(spark: SparkSession, folder: str, shards: list[tuple[int, int, int]], with_ids: bool = False) -> DataFrame:
    """One row a document from the files: key, start (ids before it in the corpus), n_tokens, ids_crc32, and ids if wanted."""
    folder = _uri(folder)
    schema = "key long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist()):
                keys, offsets, ids, n_null = open_shard(folder, shard)
                bounds = offsets.astype(np.int64)
                step = 256 if with_ids else 8192
                for a in range(0, len(keys), step):
                    b = min(a + step, len(keys))
                    flat = np.asarray(ids[bounds[a] : bounds[b]]).astype("<u4")
                    own = bounds[a : b + 1] - bounds[a]
                    own_keys = np.asarray(keys[a:b])
                    columns = [
                        pa.array(own_keys, mask=np.arange(a, b) < n_null),
                        pa.array(base + bounds[a:b]),
                        pa.array(np.diff(own)),
                        pa.array([zlib.crc32(flat[i:j]) for i, j in zip(own[:-1].tolist(), own[1:].tolist())], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(own.astype(np.int32)), pa.array(flat.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(columns, ["key", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    bases = [0, *accumulate(n for _, _, n in shards)]
    rows = [(s, b) for (s, _, _), b in zip(shards, bases)]
    plan = spark.createDataFrame(rows, "shard long, base long")
    if len(rows) > 1:
        plan = plan.repartition(len(rows))
    return plan.mapInArrow(read, schema)


def token_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, key: str = "doc_id", text: str = "text", n_ids: int | None = None) -> tuple[str, list[tuple[int, int, int]]]:
    """Write all documents in ascending key order; returns the folder and the shards' totals."""
    folder = _uri(folder or f"{shared_folder(docs.sparkSession)}/token_files")
    return folder, write_shards(docs, folder, vocabulary, end_id, key, text, n_ids)
