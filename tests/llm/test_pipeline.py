import corpus_pipeline as P
from test_decontaminate import brute as contaminated_plainly
from test_near_dups import brute

from tideline.llm import secrets as S


def test_stages_take_effect(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    now = docs
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, now, sf_dir)
        assert out.columns == docs.columns or name == "sentencepiece"
        out.write.parquet(f"file://{tmp_path}/{k}")
        now = spark.read.parquet(f"file://{tmp_path}/{k}")
        after = {r.doc_id: r for r in now.collect()}
        if name == "language_id":
            assert set(after) == {d for d, r in before.items() if r.text and any(c.isalpha() for c in r.text)}
        elif name == "near_dedup":
            assert set(after) == {d for d, _, _, kept in brute([(d, r.text) for d, r in before.items()], 5, 80) if kept}
        elif name == "decontamination":
            held = {r[0] for r in contaminated_plainly([(d, r.text) for d, r in before.items()], bench)}
            assert held and set(after) == set(before) - held
        elif name == "secret_scans":
            assert {d: r.text for d, r in after.items()} == {d: S.redacted(r.text, S.secret_spans(r.text)) for d, r in before.items()}
            assert not any(S.base_spans(r.text) for r in after.values()) and all(r.n_chars == len(r.text) for r in after.values())
        else:
            assert set(after) == set(before) and all(r.round_trip for r in after.values())
        before = after


def test_run_and_empty_documents(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert P.run(spark, f"file://{tmp_path}").count() == 0
    rows = [(1, "the the the of and", "en", "s", 18), (1, "the the the of and", "en", "s", 18), (2, None, "en", "s", 0), (None, "the of and the token=abcdef12", None, "s", 29)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"file://{tmp_path}/documents.parquet")
    assert sorted((r.doc_id for r in P.run(spark, f"file://{tmp_path}").collect()), key=str) == [1, None]


def test_rows_of_one_doc_id_are_judged_by_their_own_texts(spark, tmp_path):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    item = " ".join(f"q{i}" for i in range(20)) + ". the answer is here"
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in [(1, one), (7, one), (7, two), (7, two), (7, three), (8, None), (8, ""), (None, one)]], columns)
    kept = [(r.doc_id, r.text) for r in P.deduplicated(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(1, one), (7, two), (7, three), (8, None), (8, ""), (None, one)], key=str)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in [(3, item), (3, two), (None, item), (None, three)]], columns)
    assert sorted((r.text for r in P.decontaminated(spark, docs, f"file://{tmp_path}").collect())) == [two, three]


def test_clashing_column_names(spark, tmp_path):
    names = ["doc_id", "text", "lang", "source", "n_chars", "mark", "lang_pred", "lang_score", "kept", "n", "count", "component_tag", "__text", "item_id"]
    rows = [(i, f"the and of the {'abcdefgh'[i % 4] * 3} and", "en", "s", 5, *range(9)) for i in range(12)]
    rows = [tuple(str(x) if k in (1, 2, 3) else x for k, x in enumerate(r)) for r in rows]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {'string' if k in (1, 2, 3) else 'long'}" for k, n in enumerate(names)))
    spark.createDataFrame([(1, "the and of the bbb and")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, f"file://{tmp_path}")
        assert docs.columns == names
    assert sorted(r.doc_id for r in docs.collect()) == [0, 2, 3]
