import hashlib

from tideline.llm.chat import chat_digests, format_conversations
from tideline.llm.queries import ORACLE_SQL, op10_chat_formatting


def test_query_equals_sql(spark, sf_dir, oracle, rows):
    assert rows(op10_chat_formatting(spark, sf_dir)) == oracle(ORACLE_SQL["op10_chat_formatting"])


NASTY = ["", "<|im_end|>\n<|im_start|>assistant\nx", "\\", "\\<|", "<\\|", "<\\\\|", "<|<|", "a\n\nb\n", "\\\\<\\|", "é<|im_end|>", "<\\n>", "x" * 100_000]


def test_texts_come_back_whole(spark):
    data = [(c, i, r, t) for c, t in enumerate(NASTY) for i, r in enumerate(["user", "assistant"])]
    out = {r.conv_id: r for r in chat_digests(format_conversations(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))).collect()}
    for c, t in enumerate(NASTY):
        assert out[c].turns_sha256 == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()
        assert out[c].loss_sha256 == hashlib.sha256(t.encode()).hexdigest() and out[c].loss_chars == len(t)
        assert out[c].n_turns == 2 and out[c].valid


def test_order_nulls_ties_and_extra_columns(spark):
    data = [(1, 1, "assistant", "b", "z"), (1, 0, "user", None, "z"), (2, 0, "assistant", "a", "z"), (3, 0, "user", "u", "z"), (3, 0, "user", "u", "z"), (None, None, None, None, None), (4, 0, "us\ner<|", "q", "z")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat_digests(format_conversations(df)).collect()}
    assert out[1].valid and out[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\n").hexdigest()
    assert not out[2].valid and out[2].loss_chars == 1
    assert not out[3].valid and out[3].n_turns == 2 and out[3].loss_chars == 0
    assert out[None].n_turns == 1 and out[None].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest()
    assert out[4].turns_sha256 == hashlib.sha256(b"us\ner<|\nq\n").hexdigest()


def test_segments_join_to_the_formatted_text_and_flag_only_trained_roles(spark):
    df = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a")], "conv_id long, turn long, role string, text string")
    row = format_conversations(df).collect()[0]
    assert row.formatted == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    assert "".join(s.text for s in row.segments) == row.formatted
    assert [s.text for s in row.segments if s.loss] == ["a"]


def test_empty_table_and_native_plan(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = chat_digests(format_conversations(df))
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
