import math
import random
import re
from collections import Counter

import pytest

from tideline.llm import decontaminate as D
from tideline.llm.queries import op3_decontamination


def items(seed, n, words=25):
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(300)]
    return [(i, " ".join(rng.choices(pool, k=rng.randint(3, words))) + ". " + " ".join(rng.choices(pool, k=3))) for i in range(n)]


def plain(index, terms):
    score = {}
    for t in terms:
        for item, x in zip(*index.postings[t]):
            score[item] = score.get(item, 0) + x
    return sorted((i, s) for i, s in score.items() if s >= index.threshold - 1e-9)


@pytest.mark.parametrize("threshold", [0.05, 0.2, 0.5])
def test_wand_retrieves_all_above_the_threshold(threshold):
    index = D.ItemIndex(items(1, 90), threshold)
    rng = random.Random(2)
    for _ in range(200):
        terms = sorted(rng.sample(range(len(index.terms)), rng.randint(1, 60)))
        assert [i for i, _ in sorted(index.search(terms))] == [i for i, _ in plain(index, terms)]


def split_item(text):
    """Question and answer words, read plainly."""
    sentences = [D.words_of(x) for x in re.split(r"(?<=[.!?])\s+|\n+", text)]
    sentences = [w for w in sentences if w]
    if len(sentences) > 1:
        return sum(sentences[:-1], []), sentences[-1]
    words = sentences[0]
    cut = len(words) - max(1, len(words) // 4)
    return words[:cut], words[cut:]


def share_of_runs(part, passage, width):
    width = min(width, len(part))
    runs = lambda w: {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    return len(runs(part) & runs(passage)) / len(runs(part)) if part else 1.0


def brute(docs, bench, threshold=0.5, overlap=0.8, width=5):
    """Every item's BM25 share in every window of every document, from counts, and its runs: no index, no bounds."""
    words = {n: D.words_of(t) for n, (_, t) in enumerate(bench) if D.words_of(t)}
    mean, longest = sum(map(len, words.values())) / max(1, len(words)), max(map(len, words.values()), default=0)
    df = Counter(t for w in words.values() for t in set(w))
    weights = {}
    for n, w in words.items():
        raw = {t: math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, c in Counter(w).items()}
        weights[n] = {t: x / sum(raw.values()) for t, x in raw.items()}
    out = []
    for doc_id, text in docs:
        mine, best = D.words_of(text or ""), {}
        for start in range(0, max(1, len(mine) - longest), longest) if mine and longest else ():
            passage = mine[start : start + 2 * longest]
            there = set(passage)
            for n, w in weights.items():
                score = math.fsum(x for t, x in w.items() if t in there)
                if score < threshold - 1e-9:
                    continue
                question, answer = (share_of_runs(p, passage, width) for p in split_item(bench[n][1]))
                if question >= overlap and answer >= overlap:
                    best[n] = max(best.get(n, ()), (question, answer, score, -start))
        out += [(doc_id, bench[n][0], pytest.approx(s, abs=1e-5), q, a, -first) for n, (q, a, s, first) in best.items()]
    return sorted(out, key=lambda r: (str(r[0]), r[1]))


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (str(r[0]), r[1]))


def test_table_equals_brute_force(spark):
    bench = [*items(3, 40), (100, ""), (101, "single sentence of only a few words here")]
    rng = random.Random(5)
    docs = []
    for i in range(150):
        words = [w for _, t in rng.sample(bench, 6) for w in rng.sample(t.split(), len(t.split()) // 2)] * rng.choice((1, 3))
        if i % 4 == 0:
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(bench)[1].replace(" ", " | " if i % 8 else " ").upper().split(" ")
        docs.append((i, " ".join(words)))
    docs += [(900, None), (901, ""), (902, " !! "), (903, "x " * 50_000 + bench[0][1]), (904, bench[1][1]), (904, bench[1][1]), (None, bench[2][1]), (None, bench[3][1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, score int").repartition(3)
    bf = spark.createDataFrame([*bench, (102, None)], "item_id long, text string")
    assert got(D.contaminated(df, bf)) == brute(docs, bench)
    clean = D.uncontaminated(df, bf)
    held = {t for d, t in docs if brute([(d, t)], bench)}
    assert clean.columns == df.columns and sorted(str(r.text) for r in clean.collect()) == sorted(str(t) for _, t in docs if t not in held)
    assert D.contaminated(df, bf.limit(0)).count() == 0 and D.contaminated(df.limit(0), bf).count() == 0
    assert D.uncontaminated(df, bf.limit(0)).count() == len(docs)


def test_query_equals_brute_force(spark, sf_dir):
    read = lambda name, key: [(r[key], r.text) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()]
    assert got(op3_decontamination(spark, sf_dir)) == brute(read("documents", "doc_id"), read("benchmark", "item_id"))


def test_shards_give_the_same_rows(spark, monkeypatch):
    bench = items(7, 12)
    rows = [(i, f"before it {t} after it") for i, t in bench] + [(50 + i, " ".join(t.split()[: 3 * len(t.split()) // 4]) + " and " + bench[i - 1][1]) for i, t in bench]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bf = spark.createDataFrame(bench, "item_id long, text string")
    whole = got(D.contaminated(df, bf))
    assert {(i, i) for i, _ in bench} <= {r[:2] for r in whole}
    monkeypatch.setattr(D.item_shards, "__defaults__", (200,))
    assert len(list(D.item_shards(bf))) > 3 and got(D.contaminated(df, bf)) == whole
    assert D.uncontaminated(df, bf).count() == len(rows) - len({r[0] for r in whole})


def test_items_and_documents_split_and_fold_alike(spark):
    inner = [f"word{k}" for k in range(9)]
    bench = [(i, f"{' '.join(inner[:5])} q{i}x{space}q{i}y {' '.join(inner[5:])}. İzmir ΟΔΟΣ{space}answer{i} done") for i, space in enumerate("\u00a0\u2009\u3000\x1f\x85")]
    docs = [(i, f"before it {t} and after") for i, t in bench]
    found = got(D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")))
    assert found == brute(docs, bench) and {(i, i) for i, _ in docs} <= {r[:2] for r in found}
