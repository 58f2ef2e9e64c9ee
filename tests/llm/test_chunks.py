import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tideline.llm import chunks as C
from tideline.llm.queries import op9_substring_dedup


def split(*texts):
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    return data, offsets, *C.words(data, offsets)


def test_gear_hash_and_cuts_by_hand():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefgh ,. ") for _ in range(n)) for n in (0, 5, 700, 16, 3000)] + ["no " * 40]
    data, offsets, starts, ends, text = split(*texts)
    h = C.gear(data)
    for i in range(15, len(data)):
        assert h[i] == sum(int(C._GEAR[data[i - k]]) << k for k in range(16)) & 0xFFFF
    hashes, want = h[ends - 1].tolist(), set()
    for j in range(len(ends) - C.CUT_WORDS + 1):
        run = range(j, j + C.CUT_WORDS)
        if text[run[0]] == text[run[-1]]:
            want.add(min(run, key=lambda i: (hashes[i], -i)))
    assert C.cuts(h[ends - 1], text).tolist() == sorted(want)
    first, last, key = C.chunk_pairs(data, ends, text)
    assert len(key) > 50 and all(0 < b - a < 2 * C.CUT_WORDS and text[a] == text[b] for a, b in zip(first, last))


def test_insertions_move_no_distant_cut():
    text = "".join(random.Random(2).choices("abcdefghij ", k=5000))
    a, b = (set(C.chunk_pairs(d, e, t)[2].tolist()) for d, _, _, e, t in map(split, (text, text[:900] + "inserted" + text[900:])))
    assert len(a & b) > 0.9 * len(a)


def plain_spans(docs, least):
    """Every window of words, byte for byte, against every other document's."""
    windows, holders = {}, defaultdict(set)
    for n, (_, t) in enumerate(docs):
        raw = (t or "").encode()
        words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        windows[n] = [(i, raw[words[i][0] : words[i + least - 1][1]]) for i in range(len(words) - least + 1)], words
        for _, w in windows[n][0]:
            holders[w].add(n)
    out = []
    for n, (doc_id, _) in enumerate(docs):
        spans, words = [], windows[n][1]
        for i, w in windows[n][0]:
            if len(holders[w]) > 1:
                if spans and i <= spans[-1][1] + 1:
                    spans[-1][1] = i + least - 1
                else:
                    spans.append([i, i + least - 1])
        if spans:
            out.append((doc_id, len(spans), sum(b - a + 1 for a, b in spans), ",".join(f"{words[a][0]}:{words[b][1]}" for a, b in spans)))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.n_spans, r.n_words, r.spans) for r in op9_substring_dedup(spark, sf_dir).collect()), key=str)
    assert len(got) > 20 and got == plain_spans(docs, 50)


def test_shorter_passages_are_refused(spark):
    with pytest.raises(ValueError):
        C.repeated_passages(spark.createDataFrame([(1, "x")], "doc_id long, text string"), 49)


def sentence(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_repeats_are_found_and_clean_documents_left_alone(spark):
    passage = [sentence(f"p{i}", 60) for i in range(20)]
    rows, planted = [], set()
    for i in range(300):
        text = sentence(i, 150)
        if i % 10 < 3:
            words = text.split()
            at = 7 + i % 80
            text = " ".join([*words[:at], passage[i // 10 % 20], *words[at:]])
            planted.add(i)
        elif i % 10 == 5:
            text += " short " + sentence("s", 12)  # repeats, but not long
        elif i % 10 == 6:
            text = f"{text} {text}"  # repeats itself alone
        rows.append((i, text, "x"))
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "x" * 100_000, "x"), (None, sentence(4, 150), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(5)
    out = {r.doc_id: r for r in C.repeated_passages(df).collect()}
    assert set(out) == planted | {None, 4}
    text = {r[0]: r[1].encode() for r in rows if r[1]}
    for i in planted:
        for span in out[i].spans.split(","):
            a, b = map(int, span.split(":"))
            assert text[i][a + 5 : b - 5].decode() in passage[i // 10 % 20]  # by chance a letter or two more agree
    assert C.repeated_passages(df.limit(0)).count() == 0


def test_every_passage_of_51_words_is_found_with_exact_ends_whatever_its_bytes(spark):
    rng = random.Random(7)
    passages = [sentence(f"q{i}", 51) for i in range(150)] + [" ".join(["no"] * 51), " ".join(["a b c", "d"] * 13), "\t".join(["x"] * 51), "  ".join(rng.choice("ab") for _ in range(51))]
    few = ["short of it " + sentence("r", 46), " ".join(["yes"] * 49)]
    rows, want = [], {}
    for i, p in enumerate(passages + few):
        for k in range(2):
            lead = sentence(f"l{i}-{k}", rng.randint(0, 40)) + f" §{i}-{k} "
            rows.append((2 * i + k, f"{lead}{p} §{k} " + sentence(f"t{i}-{k}", 5)))
            if i < len(passages):
                want[2 * i + k] = f"{len(lead.encode())}:{len(lead.encode()) + len(p.encode())}"
    out = {r.doc_id: r for r in C.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {k: r.spans for k, r in out.items()} == want
    assert all(r.n_words >= 50 for r in out.values())


def test_windows_equal_brute_force():
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab \t") for _ in range(n)) for n in (0, 40, 3, 0, 200, 1, 500)]
    data, _, starts, ends, text = split(*texts)
    for least in (1, 2, 3, 5, 8, 13):
        place, key = C.windows(data, starts, ends, text, least)
        whole = "".join(texts)
        assert [whole[a:b] for a, b in zip(starts, ends)] == [w for t in texts for w in t.split()]
        assert len(place) == sum(max(0, len(t.split()) - least + 1) for t in texts)
        seen = {}
        for i, k in zip(place, key.tolist()):
            assert seen.setdefault(whole[starts[i] : ends[i + least - 1]], k) == k
        assert len(set(seen.values())) == len(seen)
