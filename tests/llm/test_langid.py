import math
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import regex

from tideline.llm import langid as L
from tideline.llm.queries import op4_language_id


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return L.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def parts(word):
    """Letter runs of a word, read plainly."""
    return [r[i : i + L.LONGEST_WORD] for r in regex.findall(r"\p{L}+", word) for i in range(0, len(r), L.LONGEST_WORD)]


def grams(word):
    padded = f"^{word}$"
    return [(n, padded[i : i + n]) for n in range(1, L.LONGEST + 1) for i in range(len(padded) - n + 1)]


def plain_tables(rows, least_seen=3):
    """Log frequencies by unit, counted word by word."""
    counts, langs = defaultdict(Counter), sorted({lang for _, lang in rows})
    for text, lang in rows:
        for p in (p for w in text.lower().split() for p in parts(w)):
            counts[0, p][lang] += 1
            for g in grams(p):
                counts[g][lang] += 1
    total = Counter()
    for (kind, _), by in counts.items():
        for lang, n in by.items():
            total[kind, lang] += n
    kept = {k: by for k, by in counts.items() if k[0] or sum(by.values()) >= least_seen}
    return langs, {k: [math.log((by[x] + 0.1) / (total[k[0], x] + 1000)) for x in langs] for k, by in kept.items()}


def plain_score(langs, table, word, step=math.log(0.4), floor=math.log(1e-6)):
    out = []
    for part in parts(word):
        if (0, part) in table:
            out.append(table[0, part])
            continue
        padded, rows = f"^{part}$", []
        for i in range(len(padded)):
            n = max((n for n in range(1, L.LONGEST + 1) if i + n <= len(padded) and (n, padded[i : i + n]) in table), default=0)
            rows.append([x + step * (L.LONGEST - n) for x in table[n, padded[i : i + n]]] if n else [floor] * len(langs))
        out.append([sum(c) / len(rows) for c in zip(*rows)])
    return [sum(c) for c in zip(*out)]


def told(langs, table, text):
    """Language and belief of a text, or None without a letter."""
    words = [w for w in text.lower().split() if parts(w)]
    if not words:
        return None
    total = [sum(c) for c in zip(*(plain_score(langs, table, w) for w in words))]
    best = max(range(len(total)), key=lambda i: (total[i], -i))
    return langs[best], 1 / sum(math.exp(t - total[best]) for t in total)


def test_held_out_accuracy(spark, sf_dir, model):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {r.doc_id: r for r in L.identify(docs, model).collect()}
    fold = [r for r in docs.select("doc_id", "lang", "text").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(fold) > 20 and sum(out[r.doc_id].lang_pred == r.lang for r in fold) >= 0.97 * len(fold)


def test_predictions_equal_the_plain_reading(spark):
    rows = [("der die und straße und", "de"), ("the of and the thing", "en"), ("la de los niño niño y de", "es"), ("und the " * 9 + "z" * 70, "de")] * 2
    docs = [(i, *rows[n]) for n, i in enumerate([i for i in range(99) if zlib.crc32(str(i).encode()) % 5][: len(rows)])]
    model = L.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    langs, table = plain_tables(rows)
    assert model.langs == langs and len(model.units) == len(table)
    texts = ["the of xqzzt und", "la de los niño mentación", "12 34 --", "", "Straße überall ßß", "x" * 300, "z" * 70, "don't l'été ab1cd", "日本 语言", "^a$ $^"]
    lang, share = model.predict(pa.array(texts, pa.large_string()))
    for text, got, s in zip(texts, lang, share):
        want = told(langs, table, text)
        if want is None:
            assert (got, s) == ("und", 0)
        else:
            assert got == want[0] and s == pytest.approx(want[1], abs=2e-6)


def test_every_held_out_document_of_the_query_equals_the_plain_reading(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    langs, table = plain_tables([(r.text, r.lang) for r in rows if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5])
    got = {r.doc_id: r for r in op4_language_id(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r in rows[:60]:
        want = told(langs, table, r.text or "")
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert got[r.doc_id].lang_pred == (want[0] if want else "und")


def knows(model, word):
    return bool((model._find(L.parts_of(pa.array([word], pa.large_string())).hashes()) >= 0).all())


def test_training_ignores_the_held_out_fold(spark):
    data = [(i, "nur wort" if zlib.crc32(str(i).encode()) % 5 == 0 else "other thing", "aa") for i in range(60)]
    model = L.train(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    assert [knows(model, w) for w in ("other", "thing", "nur", "wort")] == [True, True, False, False]


def test_sample_bound_and_nulls(spark):
    data = [(i, f"word{'abcdefghij'[i % 10]} " * 5, "aa") for i in range(200)] + [(None, "x y", "aa"), (1000, None, "aa"), (1001, "zz zz zz", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    small = L.train(df, sample_docs=3)
    assert small.langs == ["aa"] and 1 <= sum(knows(small, f"word{x}") for x in "abcdefghij") <= 3
    assert not knows(L.train(df), "zz")
    empty = L.train(df.limit(0))
    assert [tuple(r) for r in L.identify(df.where("doc_id = 1"), empty).collect()] == [(1, "und", 0.0)]


def test_every_language_is_learned(spark):
    data = [(i, f"common{i % 7} words here", "big") for i in range(400)] + [(1000 + i, f"rara{chr(97 + i % 26)} avis {chr(0x3B1 + i % 20) * 3}", f"l{i:03d}") for i in range(260) if zlib.crc32(str(1000 + i).encode()) % 5]
    model = L.train(spark.createDataFrame(data, "doc_id long, text string, lang string"), sample_docs=5)
    assert len(model.langs) == len({lang for *_, lang in data}) > 200
    lang, share = model.predict(pa.array(["common1 words here common2"], pa.large_string()))
    assert lang == ["big"] and 0 < share[0] <= 1


def test_rows_columns_and_empty_table(spark, model):
    data = [(1, None, 5), (1, None, 5), (2, "", 5), (None, "the and of", 5), (3, "the " * 100_000, 5), (4, "１２３ !!", 5)]
    df = spark.createDataFrame(data, "doc_id long, text string, score long")
    got = sorted(((r.doc_id, r.lang_pred) for r in L.identify(df, model).collect()), key=str)
    assert got == sorted([(1, "und"), (1, "und"), (2, "und"), (None, "en"), (3, "en"), (4, "und")], key=str)
    assert L.identify(df.limit(0), model).count() == 0
