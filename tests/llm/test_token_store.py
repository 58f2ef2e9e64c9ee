import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tideline.llm import token_store as S

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "a", "Hello World", "it's 'S don't'RE", "a<|startoftext|>b <|STARTOFTEXT|> <|endoftext|>", "İstanbul ΟΔΟΣ Σ", "é é ́x ﬁ Å", "x y z​q",
    "１２ ½ x12y", "<|", "word, word. (word) 12|34!!", "ß ẞ ǅ", "\tA\n\nB\r\n", "😀😀 👩‍👩‍👧", "a" * 3000, "snake_case _x_ __", "各国 語", "a\x00b", "͸ ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library(library):
    ids, offsets = S.SegmentEncoder(PATH).encode(pa.array(ODD, pa.large_string()), 1)
    for i, text in enumerate(ODD):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == [*library.encode(text, add_special_tokens=False).ids, 1], text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_equals_the_library(text):
    encoder = S._ENCODERS.get(PATH) or S._ENCODERS.setdefault(PATH, S.SegmentEncoder(PATH))
    ids, _ = encoder.encode(pa.array([text], pa.large_string()), 1)
    assert ids.tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_rolling_hash_by_hand():
    ids = np.random.default_rng(3).integers(0, 49000, 5000).astype("<u2")
    marks = set(S.cut_marks(ids).tolist())
    for i in range(8, len(ids)):
        h = sum(int(S._GEAR[ids[i - k]]) << (4 * k) for k in range(8)) & 0xFFFFFFFF
        assert (h >> 24 == 0) == (i + 1 in marks)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 9000), st.sets(st.integers(1, 9000), max_size=60))
def test_chunks_cover_the_stream_within_bounds(size, marks):
    ends = S.chunk_ends(np.array(sorted(m for m in marks if m <= size), dtype=np.int64), size)
    sizes = np.diff([0, *ends])
    assert ends[-1] == size and (sizes > 0).all() and (sizes <= S.MOST).all() and (sizes[:-1] >= S.LEAST).all()


def test_cuts_resist_an_insertion():
    ids = np.random.default_rng(1).integers(0, 49000, 20000).astype("<u2")
    moved = np.concatenate([ids[:500], np.array([7, 8, 9], "<u2"), ids[500:]])
    chunks = [{ids_[a:b].tobytes() for a, b in zip([0, *e], e)} for ids_ in (ids, moved) for e in [S.chunk_ends(S.cut_marks(ids_), len(ids_))]]
    assert len(chunks[0] & chunks[1]) >= 0.8 * len(chunks[0])


def test_crc_of_joined_chunks():
    shifts = S.crc_shifts(1024)
    a, b = (np.random.default_rng(i).integers(0, 1 << 16, n).astype("<u4") for i, n in ((1, 300), (2, 1024)))
    joined = S._times(np.array([zlib.crc32(a)], np.uint64), shifts[[len(b)]]) ^ np.uint64(zlib.crc32(b))
    assert int(joined[0]) == zlib.crc32(np.concatenate([a, b]))


def expected(library, data):
    out, start = [], 0
    for doc_id, text in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    return out


def test_round_trip_nulls_repeats_long_texts_and_extra_columns(spark, library, tmp_path):
    data = [(5, "Hello there"), (2, None), (9, "word " * 30_000), (2, None), (3, ""), (None, "no id"), (7, "Hello there"), *[(100 + i, t) for i, t in enumerate(ODD)]]
    df = spark.createDataFrame([(d, t, 1) for d, t in data], "doc_id long, text string, part int")
    path = f"file://{tmp_path}/store"
    out = S.token_store(df, PATH, 1, path)
    got = out.collect()
    assert [tuple(r)[:4] for r in sorted(got, key=lambda r: r.start)] == expected(library, data)
    assert all(r.verified for r in got)
    back = {r.doc_id: r.ids for r in S.read_documents(spark, path).collect()}
    assert back == {d: [*library.encode(t or "", add_special_tokens=False).ids, 1] for d, t in data}
    stored = spark.read.parquet(f"{path}/kind=0")
    assert stored.count() == stored.select("key").distinct().count()


def test_damage_is_found(spark, tmp_path):
    df = spark.createDataFrame([(i, f"some text number {i}") for i in range(5)], "doc_id long, text string")
    S.write_store(df, PATH, 1, f"file://{tmp_path}/a")
    recipes = spark.read.parquet(f"file://{tmp_path}/a/kind=1").collect()
    chunks = spark.read.parquet(f"file://{tmp_path}/a/kind=0").collect()
    bad = bytes(recipes[0]["body"])[:16]
    rows = [(c.part, c.doc_id, c.n, bytes(c.key), b"\x01\x00" * c.n if bytes(c.key) == bad else bytes(c.body)) for c in chunks]
    spark.createDataFrame(rows, "part int, doc_id long, n int, key binary, body binary").write.mode("overwrite").parquet(f"file://{tmp_path}/b/kind=0")
    spark.read.parquet(f"file://{tmp_path}/a/kind=1").write.parquet(f"file://{tmp_path}/b/kind=1")
    spark.read.parquet(f"file://{tmp_path}/a/manifest").write.parquet(f"file://{tmp_path}/b/manifest")
    assert sorted(r.verified for r in S.read_store(spark, f"file://{tmp_path}/b").collect()) == [False, True, True, True, True]


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.token_store(df, PATH, 1, f"file://{tmp_path}/e").count() == 0


def test_documents_equal_the_library(spark, library, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = S.token_store(docs, PATH).collect()
    assert sorted(tuple(r)[:4] for r in got) == expected(library, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert all(r.verified for r in got)


@pytest.mark.parametrize("damage", ["doc_id != 2", "all", "renamed"])
def test_lost_added_and_renamed_recipes_are_found(spark, tmp_path, damage):
    df = spark.createDataFrame([(i, f"some text number {i}") for i in range(5)], "doc_id long, text string")
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    S.write_store(df, PATH, 1, a)
    for part in ("kind=0", "manifest"):
        spark.read.parquet(f"{a}/{part}").write.parquet(f"{b}/{part}")
    recipes = spark.read.parquet(f"{a}/kind=1")
    if damage == "all":
        recipes = recipes.unionByName(recipes.where("doc_id = 2"))
    elif damage == "renamed":
        recipes = recipes.selectExpr("part", "if(doc_id = 2, 3, doc_id) AS doc_id", "n", "key", "body")
    else:
        recipes = recipes.where(damage)
    recipes.write.parquet(f"{b}/kind=1")
    assert all(r.verified for r in S.read_store(spark, a).collect())
    out = S.read_store(spark, b).collect()
    assert out and not any(r.verified for r in out if r.doc_id in (1, 2, 3))


def test_equal_chunks_of_a_part_go_in_any_order():
    def batch(kinds, keys):
        n = len(keys)
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array([0] * n, pa.int32()), pa.array([None] * n, pa.int64()), pa.array([1] * n, pa.int32()), pa.array(keys, pa.binary()), pa.array(keys, pa.binary())], ["kind", "part", "doc_id", "n", "key", "body"])

    out = list(S._once(iter([batch([0, 0, 0], [b"a", b"b", b"a"]), batch([0, 1, 1], [b"b", b"c", b"c"]), batch([0], [b"d"])])))
    assert [k for b in out for k in b.column(4).to_pylist()] == [b"a", b"b", b"c", b"c", b"d"]
