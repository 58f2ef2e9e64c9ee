import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tideline.llm.token_counts import ByteBpe, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  ", "a  b", "a   b", "a\n b", "a \n b", " a", "a ", " \n", " 's it's  don't", "a<|endoftext|>b", "a <|endoftext|> b",
    "a\n <|endoftext|>", "<|endoftext|>", "a\n \nb", "a" * 15, "  x  y", "x" * 5000, "ab" * 3000, "１２ ½   x", "it 's  'll", " \t \t x",
    "́a ́", "é 😀😀😀 x", "aaaaaaa !!!!!!!!!", "a  <|endoftext|>", "x ​ y", "word, word. (word) 12|34",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_equal_the_library(library):
    got = ByteBpe(PATH).counts(pa.array(ODD, pa.large_string()))
    assert got.tolist() == [len(library.encode(x, add_special_tokens=False).ids) for x in ODD]


def test_nulls_repeats_extra_columns_and_limit(spark, library):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (4, "word " * 2000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, token_counts(df, PATH).collect()), key=str)
    long = len(library.encode("word " * 2000, add_special_tokens=False).ids)
    assert got == sorted([(1, 3, 2, False), (1, 3, 2, False), (None, 0, 0, False), (4, 10000, long, True)], key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts(df, PATH).count() == 0


def test_documents_equal_the_library(spark, library, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, PATH).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == len(library.encode(r.text or "", add_special_tokens=False).ids)


def test_files_with_other_rules_are_refused(tmp_path):
    for name in ("word_bpe_49k.json",):
        with pytest.raises(ValueError):
            ByteBpe(public_tokenizers.path(name))
