import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pantry.llm import stats
from pantry.llm import text as T
from pantry.llm import vocab
from tests.llm.cases import lowered, words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbé漢 \n\t\x0b\x1c\x85　.,'<|>1!s", max_size=40)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_and_shingles(texts):
    data, offsets = T.view(pa.array(texts, pa.string()))
    first, end, ranges = T.words(data, offsets)
    own = [[data[a:b].tobytes().decode() for a, b in zip(first[i:j], end[i:j])] for i, j in zip(ranges, ranges[1:])]
    assert own == [words(t) for t in texts]
    hashes = T.span_hashes(T.lower(data), first, end)
    made, _, rows = T.shingles(hashes, ranges, 3)
    seen = {}
    for t, i, j in zip(texts, rows, rows[1:]):
        w = words(lowered(t))
        expected = [tuple(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else ([tuple(w)] if w else [])
        assert j - i == len(expected)
        for h, e in zip(made[i:j].tolist(), expected):
            assert seen.setdefault(h, e) == e
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_units_encode_as_whole_texts(texts):
    column = pa.array(texts, pa.string())
    for name, drop in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        encoder = vocab.encoder(public_tokenizers.path(name), drop)
        ids, ranges = encoder.encode(*T.view(column), 7)
        whole = encoder.model.encode_batch([t or "" for t in texts], add_special_tokens=False)
        assert [ids[a:b].tolist() for a, b in zip(ranges, ranges[1:])] == [[*x.ids, 7] for x in whole]


def test_special_strings_are_text_and_the_table_may_be_emptied(monkeypatch):
    encoder = vocab.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    column = pa.array(["a <|endoftext|> b", "c"])
    before = encoder.encode(*T.view(column))[0].tolist()
    assert 50256 not in before
    monkeypatch.setattr(vocab, "CACHE_UNITS", 0)
    assert encoder.encode(*T.view(column))[0].tolist() == before


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab# \n", max_size=60), max_size=6))
def test_base_counts(texts):
    from collections import Counter

    b = stats.base(*T.view(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        w = words(t)
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (b["n_words"][i], b["word_chars"][i], b["n_symbols"][i], b["n_dup_lines"][i], b["n_repeat_words"][i]) == (len(w), sum(map(len, w)), t.count("#"), len(lines) - len(set(lines)), len(covered))


def test_slices_cover_all_rows_once():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (0, 5, 50, 3, 0, 200, 1)], "i": list(range(7))})
    assert [x for s in T.slices(batch, limit=10) for x in s.column("i").to_pylist()] == list(range(7))
    assert np.all([s.num_rows for s in T.slices(batch, limit=10)])
