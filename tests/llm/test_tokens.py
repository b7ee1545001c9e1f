"""Packing, token files and chat formatting: exact round trips."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pantry.llm import chat, packing, queries, token_files
from tests.llm.cases import alike, empty, odd, plain, prose

WORD, BYTE = queries.vocabulary("word_bpe_49k.json"), queries.vocabulary("byte_bpe_50k.json")


def ids_of(path, texts, end):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [np.array([*x.ids, end], "<u4") for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_packing_round_trip(spark):
    docs = odd(spark)
    rows = docs.collect()
    stream = packing.encoded(docs, WORD, 2)
    packed = packing.sequences(stream, 64, pad_id=9)
    whole = {r["sequence_id"]: r for r in packed.collect()}
    expected = sorted((-1 if r["doc_id"] is None else r["doc_id"], x.tobytes()) for r, x in zip(rows, ids_of(WORD, [r["text"] for r in rows], 2)))
    ordered = sorted((r.asDict() for r in packing.pieces(packed).collect()), key=lambda r: (r["sequence_id"], r["offset"]))
    back, now, at = [], b"", {}
    for r in ordered:
        ids = whole[r["sequence_id"]]["ids"][4 * r["offset"] : 4 * (r["offset"] + r["length"])]
        assert r["length"] > 0 and zlib.crc32(ids) == r["ids_crc32"] and r["start"] * 4 == len(now) and r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
        now += ids
        if len(now) == 4 * r["doc_tokens"]:
            back.append((-1 if r["key"] is None else r["key"], now))
            now = b""
    assert not now and sorted(back) == expected
    assert sorted(whole) == list(range(-(-sum(r["length"] for r in ordered) // 64))) == sorted(at)
    for i, r in whole.items():
        assert len(r["ids"]) == 4 * packing.padded_length(r["n_ids"], 64) and at[i] == r["n_ids"]
        assert r["n_ids"] == 64 or i == len(whole) - 1
        assert np.all(np.frombuffer(r["ids"], np.uint32)[r["n_ids"] :] == 9)
    assert packing.pieces(packing.sequences(packing.encoded(empty(spark), WORD, 2))).count() == 0


def test_words_that_hash_alike_get_their_own_ids(spark, tmp_path):
    x, y = alike()
    docs = plain(spark, [x, y, f"{y} {x}", "a"]).coalesce(1)
    cut = packing.pieces(packing.sequences(packing.encoded(docs, WORD, 2), 1 << 16))
    assert {r["key"]: r["ids_crc32"] for r in cut.collect()} == {i: zlib.crc32(ids) for i, ids in enumerate(ids_of(WORD, [x, y, f"{y} {x}", "a"], 2))}
    folder, shards = token_files.token_files(docs, BYTE, 0, folder=str(tmp_path / "alike"))
    assert {r["key"]: r["ids_crc32"] for r in token_files.read_documents(spark, folder, shards).collect()} == {i: zlib.crc32(ids) for i, ids in enumerate(ids_of(BYTE, [x, y, f"{y} {x}", "a"], 0))}


def test_units_with_one_hash_get_their_own_ids(monkeypatch):
    from pantry.llm import text as T
    from pantry.llm import vocab

    import pyarrow as pa

    monkeypatch.setattr(T, "span_hashes", lambda data, first, end, salt=0: (end - first).astype(np.uint64) % np.uint64(3))
    texts = [prose(i, 30, 50) for i in range(20)] + ["The Cat", "the cat"]
    for path, kind in ((WORD, True), (BYTE, False)):
        encoder = vocab.UnitEncoder(path, kind)
        for _ in range(2):  # the second time all hashes are known
            ids, ranges = encoder.encode(*T.view(pa.array(texts)), 2)
            assert [ids[a:b].tolist() for a, b in zip(ranges, ranges[1:])] == [x.tolist() for x in ids_of(path, texts, 2)]


def test_token_files_width_and_null_keys(spark, tmp_path):
    docs = spark.createDataFrame([(None, "b"), (-(2**63), "a"), (5, "c")], "doc_id long, text string").coalesce(1)
    folder, shards = token_files.token_files(docs, BYTE, 0, folder=str(tmp_path / "null"))
    assert [r["key"] for r in token_files.read_documents(spark, folder, shards).orderBy("start").collect()] == [None, -(2**63), 5]
    with pytest.raises(Exception, match="beyond the vocabulary"):
        token_files.token_files(docs, BYTE, 0, folder=str(tmp_path / "narrow"), n_ids=10)


def test_padding():
    assert [packing.padded_length(n) for n in (1, 2, 3, 512, 513, 4096)] == [1, 2, 4096, 512, 4096, 4096]


def test_token_files_round_trip(spark, tmp_path):
    docs = odd(spark)
    folder, shards = token_files.token_files(docs, BYTE, 0, folder=str(tmp_path / "files"))
    got = [r.asDict() for r in token_files.read_documents(spark, folder, shards, with_ids=True).collect()]
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    ids = ids_of(BYTE, [r["text"] for r in rows], 0)
    starts = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
    got.sort(key=lambda r: r["start"])
    assert [(r["key"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == [(r["doc_id"], s, len(x), zlib.crc32(x)) for r, s, x in zip(rows, starts.tolist(), ids)]
    assert all(r["ids"] == x.tolist() for r, x in zip(got, ids))
    keys, offsets, flat, _ = token_files.open_shard(folder, shards[0][0])
    assert isinstance(flat, np.memmap) and flat.dtype == np.uint16 and offsets.dtype == np.uint64
    (tmp_path / "files" / f"shard-{shards[0][0]:05d}.ids").write_bytes(b"ab")
    with pytest.raises(ValueError):
        token_files.open_shard(folder, shards[0][0])
    folder, shards = token_files.token_files(empty(spark), BYTE, 0)
    assert token_files.read_documents(spark, folder, shards).count() == 0


@pytest.mark.parametrize("text", ["<|", "<\\|", "<\\\\|im_end|>", "a<b|c", "<|im_end|><|im_start|>assistant ok", "<<||", ""])
def test_escape(text):
    escaped = chat.escape(text)
    assert "<|" not in escaped and chat.unescape(escaped) == text


def test_columns_are_escaped_as_texts_are():
    import pyarrow as pa

    texts = ["<|", "<\\|", "<\\\\|im_end|>", "a<b|c", "<<||", "", "é<|漢", "<\\x|<\\\\\\||"]
    assert chat.escaped(pa.array(texts)).to_pylist() == [chat.escape(x) for x in texts]


def test_byte_level_ids_are_read_as_the_library_reads_them():
    import pyarrow as pa

    from pantry.llm import text as T
    from pantry.llm import vocab

    texts = [prose(i, 20, 50) for i in range(20)] + ["", "\x00\x7f\xad\x80ÿ\u2028", "é漢😀 \t\r\n", "<|endoftext|>", "".join(map(chr, range(1, 1500)))]
    encoder = vocab.encoder(BYTE)
    ids, ranges = encoder.encode(*T.view(pa.array(texts)))
    data, own = encoder.decode(ids)
    assert [data[own[a] : own[b]].decode() for a, b in zip(ranges, ranges[1:])] == texts
    assert [encoder.model.decode(ids[a:b].tolist(), skip_special_tokens=False) for a, b in zip(ranges, ranges[1:])] == texts
    every = np.arange(encoder.model.get_vocab_size())
    data, own = encoder.decode(every)
    assert all(data[own[i] : own[i + 1]].decode("utf-8", "replace") == encoder.model.decode([i], skip_special_tokens=False) for i in every.tolist())


def test_chat_frames_are_checked(spark):
    rows = chat.formatted(spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string"), BYTE)
    with pytest.raises(Exception, match="not framed"):
        chat.read_back(rows.withColumn("ids", F.expr("substring(ids, 5)")), BYTE).collect()


def test_chat_round_trip(spark):
    turns = [
        (1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "a\nb <\\|im_start|> c"), (1, 2, "assistant", None), (1, 2, "assistant", None),
        (2, None, None, "x"), (2, 3, "system\n", "<|im_start|>assistant\nno"), (None, 0, "assistant", "é漢😀"), (3, 0, "assistant", prose(1, 30_000)),
    ]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1)).withColumn("h", F.lit(2)).withColumn("offset", F.lit(3))
    rows = chat.formatted(table, BYTE)
    got = {r["conv_id"]: r for r in chat.read_back(rows, BYTE).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv in got:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0))
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == sum(len(f"<|im_start|>{chat.escape(a or '')}\n{chat.escape(b or '')}<|im_end|>\n") for _, _, a, b in own)
    spans = rows.where("conv_id = 1").orderBy("offset").collect()
    assert [r["offset"] for r in spans] == np.concatenate(([0], np.cumsum([r["n_ids"] for r in spans])))[:-1].tolist()
    assert chat.read_back(chat.formatted(table.limit(0), BYTE), BYTE).count() == 0
