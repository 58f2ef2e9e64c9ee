import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from tideline.llm import pieces as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
SMALL = S.PieceModel(pieces=[("<unk>", 0.0, S.UNKNOWN), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.0, 1), ("c", -4.0, 1), ("ab", -3.0, 1), ("▁a", -3.5, 1), ("bc", -4.5, 1), ("abc", -6.0, 1), ("▁ab", -5.0, 1), ("▁▁", -5.5, 1)])


@pytest.fixture(scope="module")
def model():
    return S.PieceModel(PATH)


def all_paths(model, word):
    """Every path of a lattice as (-score, starts from the end, pieces)."""
    if not word:
        return [(0.0, (), [])]
    out = []
    for a in range(len(word)):
        found = model.scores.get(word[a:])
        if found is None and len(word) - a == 1:
            found = (model.unknown_score, -1)
        if found is not None:
            out += [(n - found[0], (a, *s), [*p, found[1]]) for n, s, p in all_paths(model, word[:a])]
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.text("abcx ", max_size=9), st.integers(1, 6))
def test_a_star_equals_all_paths(text, n):
    word = S.MARK + text.replace(" ", S.MARK)
    want = all_paths(SMALL, word)
    got = SMALL.nbest(word, n)
    assert [(pytest.approx(-w[0]), w[2]) for w in want[:n]] == [(g[0], g[1]) for g in got]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcx ", max_size=9), min_size=1, max_size=4), st.integers(2, 5))
def test_texts_at_once_equal_all_paths(texts, n):
    model = S.PieceModel(pieces=SMALL.pieces)
    for text, (count, crc, score, losses, _) in zip(texts, model.encode_all(pa.array(texts, pa.large_string()), n)):
        want = all_paths(SMALL, S.MARK + text.replace(" ", S.MARK) if text else "")
        ids = [i if i >= 0 else 0 for i in want[0][2]]
        assert (count, crc) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert [score - x for x in losses] == pytest.approx([-w[0] for w in want[:n]])


def as_unigram(pieces):
    """The small model as a file of the library, of the kind that searches by score."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    field = lambda k, data: varint(k << 3 | 2) + varint(len(data)) + data
    import struct

    out = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + varint(k)) for p, s, k in pieces)
    return out + field(2, b"\x18\x01") + field(3, field(1, b"identity") + b"\x18\x01\x20\x00\x28\x01")


def test_scores_equal_the_library(tmp_path):
    pieces = [("<unk>", 0.0, S.UNKNOWN), ("<s>", 0.0, S.CONTROL), ("</s>", 0.0, S.CONTROL), *SMALL.pieces[1:]]
    library = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(pieces))
    own = S.PieceModel(pieces=pieces)
    for text in ["abcab", "a b c", "ab  abc", "cab bca", "aaabbbccc"]:
        got = [library.piece_to_id(p) for p in library.encode(text, out_type=str)]
        score = lambda ids: sum(pieces[i][1] for i in ids)
        assert score(own.encode(text)) == pytest.approx(score(got))
        want = sorted((score(ids) for ids in library.nbest_encode_as_ids(text, 4)), reverse=True)
        count, _, best, losses, _ = own.encode_all(pa.array([text], pa.large_string()), 4)[0]
        assert [best - x for x in losses] == pytest.approx(want)


def test_round_trips(model):
    texts = ["", " ", "a", "  two  spaces ", "Ünï 各国 😀\x00\t\n", "word " * 50, "x" * 400, "▁"]
    for text, row in zip(texts, model.encode_all(pa.array(texts, pa.large_string()), 3)):
        assert (model.decode(model.encode(text)) == text) == row[4] == ("▁" not in text), text
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert all(library.decode(model.encode(t)) == t for t in texts[:-1])


def test_table_cases(spark):
    data = [(1, "some text", 1), (1, "some text", 1), (2, None, 1), (None, "", 1), (3, "long " * 20_000 + "x" * 20_000, 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, score int")
    out = S.encode_pieces(df, PATH).collect()
    assert sorted((r.doc_id for r in out), key=str) == [1, 1, 2, 3, None]
    assert all(r.round_trip and r.nbest_scores[0] == r.score for r in out)
    assert all(r.n_pieces == 0 and r.nbest_scores == [0.0] for r in out if r.doc_id in (2, None))
    back = S.decode_ids(S.encode_ids(df, PATH), PATH).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted([(d, t or "") for d, t, _ in data], key=str)
    assert S.encode_pieces(df.limit(0), PATH).count() == 0


def test_documents_against_the_plain_search(spark, sf_dir, model):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    out = S.encode_pieces(docs, PATH, n=3).collect()
    assert len(out) == len(text) and all(r.round_trip for r in out)
    for r in out[::20]:
        paths = [model.nbest(w, 1)[0] for w in model.words(text[r.doc_id])]
        assert r.score == pytest.approx(sum(s for s, _ in paths), abs=2e-6)
        ids = [i for w, (_, p) in zip(model.words(text[r.doc_id]), paths) for i in model.encode(w[1:])]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and r.n_pieces == len(ids)


def test_best_paths_near_the_merge_order_and_merged_ids_equal_the_library(spark, sf_dir, model):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    rows = docs.select("doc_id", "text").collect()
    merged = {r.doc_id: r.ids for r in S.encode_ids(docs, PATH, merged=True).collect()}
    assert all(merged[r.doc_id] == library.encode(r.text or "") for r in rows)
    assert model.kind == S.MERGES
    words = Counter(w[1:] for r in rows for w in model.words(r.text or "") if w.count(S.MARK) == 1)
    same = sum(n for w, n in words.items() if model.encode(w) == library.encode(w))
    own, theirs = (sum(n * len(f(w)) for w, n in words.items()) for f in (model.encode, library.encode))
    assert same >= 0.8 * sum(words.values()) and 0.97 < own / theirs <= 1.0


def test_pieces_over_word_beginnings_are_refused():
    with pytest.raises(ValueError):
        S.PieceModel(pieces=[*SMALL.pieces, ("a▁b", -1.0, S.NORMAL)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcx ", max_size=12), min_size=1, max_size=4), st.integers(1, 5))
def test_ids_of_the_n_best_paths_are_theirs(texts, n):
    model = S.PieceModel(pieces=SMALL.pieces)
    for text, row in zip(texts, model.encode_paths(pa.array(texts, pa.large_string()), n)):
        paths = [np.frombuffer(x, "<u4").tolist() for x in row[5]]
        assert len(paths) == len(row[3]) and len({tuple(p) for p in paths}) == len(paths) and len(paths[0]) == row[0]
        for ids, loss in zip(paths, row[3]):
            assert sum(model.pieces[i][1] if i else model.unknown_score for i in ids) == pytest.approx(row[2] - loss)
            assert "".join(model.spelled[i] if i else "x" for i in ids) == (S.MARK + text.replace(" ", S.MARK) if text else "")


def test_operator_gives_the_ids_of_every_path(spark, model, monkeypatch):
    monkeypatch.setattr(S, "IDS_AT_ONCE", 30)
    data = [(1, "some text of several words"), (2, None), (None, ""), (3, "two  spaces ▁ and 各国 😀"), (4, "one"), (5, "word " * 300)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(2)
    out = {r.doc_id: r for r in S.encode_pieces(df, PATH, n=4).collect()}
    for doc_id, text in data:
        row = out[doc_id]
        assert row.ids == row.nbest_ids[0] == model.encode(text or "") and len(row.ids) == row.n_pieces
        assert len(row.nbest_ids) == len(row.nbest_scores) == (4 if text else 1)
        assert zlib.crc32(np.array(row.ids, "<u4").tobytes()) == row.ids_crc32
        assert all(model.decode(ids) == (text or "").replace("▁", " ") for ids in row.nbest_ids)


def test_trimmed_batches_are_all_there_and_memory_goes_back():
    from tideline.llm import arrowtext

    batches = [pa.RecordBatch.from_pydict({"x": [i]}) for i in range(3)]
    assert list(arrowtext.trimmed(lambda given: (b for b in given))(iter(batches))) == batches
    assert list(arrowtext.trimmed(S._encode_batches(PATH, 2))(iter([]))) == []
