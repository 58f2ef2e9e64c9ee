import random
from collections import defaultdict

import pyarrow as pa

from tideline.llm import near_dups as N
from tideline.llm.queries import op2_minhash_near_dedup


def plain_set(text, width):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys([0x20, *range(9, 14)], " ")).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def brute(rows, width, percent):
    """Components over all pairs that share a shingle."""
    sets = {d: plain_set(t, width) for d, t in rows}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for pair in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        a, b = (sets[p] for p in pair)
        if 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted(map(find, pair))
            root[y] = x
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets.items())


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def test_sets_equal_the_plain_reading():
    texts = ["a b c d e", "A  b\tC d\n", "x", "x y", "", " \n", "É é b c d", "w " * 50, "a b c d a b c d"]
    sizes = [len(s) for s in N.shingle_sets(pa.array(texts, pa.large_string()), 4)]
    assert sizes == [len(plain_set(t, 4)) for t in texts]
    a, b, c = (s.tolist() for s in N.shingle_sets(pa.array(["one two", "ONE two", "two one"], pa.large_string()), 4))
    assert a == b != c


def test_documents_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(op2_minhash_near_dedup(spark, sf_dir)) == sorted(brute(rows, 4, 80), key=str)


def test_groups_edges_nulls_and_hot_passages(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 7)
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijk", k=rng.randint(2, 7)))
    base = [[word() for _ in range(rng.choice((6, 30, 120, 300)))] for _ in range(12)]
    hot = [word() for _ in range(60)]
    rows, n = [], 0
    for words in base:
        for _ in range(10):
            copy = list(words)
            for _ in range(rng.choice((0, 0, 1, 2, len(words) // 40, len(words) // 20))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy)))
            n += 1
    for i in range(60):  # a passage that makes up most of many documents
        own = [word() for _ in range(rng.choice((5, 15, 40, 200)))]
        rows.append((n + i, " ".join([*own, *hot])))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "solo"), (1004, "SOLO"), (1005, "x y z"), (1006, "z y x")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int").repartition(3)
    assert got(N.near_duplicates(df, 4, 80)) == sorted(brute(rows, 4, 80), key=str)


def test_texts_of_one_doc_id_are_linked_each_by_its_own(spark):
    words = [f"w{i}" for i in range(120)]
    one, two, like_two = " ".join(words), " ".join(words[::-1]), " ".join([*words[::-1][:-2], "x", "y"])
    df = spark.createDataFrame([(1, one, "p"), (1, two, "q"), (3, like_two, "r"), (4, one, "s"), (5, "other words " * 9, "t")], "doc_id long, text string, mine string").repartition(2)
    found = {r.mine: (r.component_id, r.kept) for r in N.near_duplicates(df, 4, 80, keep=("mine",)).collect()}
    assert found == {"p": (1, True), "q": (1, True), "r": (1, False), "s": (1, False), "t": (5, True)}
    tags = {r.mine: r.component_tag for r in N.near_duplicates(df, 4, 80, keep=("mine",)).collect()}
    assert tags["p"] == tags["s"] != tags["q"] == tags["r"]


def test_very_long_text_and_salted_lists(spark, monkeypatch):
    monkeypatch.setattr(N, "SALT_ROWS", 3)
    monkeypatch.setattr(N, "BLOCK", 2)
    rng = random.Random(8)
    long = [f"w{rng.randrange(5000)}" for _ in range(200_000)]
    hot = [f"h{i}" for i in range(40)]
    rows = [(1, " ".join(long)), (2, " ".join([*long, "more"]))] + [(10 + i, " ".join([*hot, *(f"o{i}x{k}" for k in range(rng.choice((1, 2, 3, 9, 15))))])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(N.near_duplicates(df, 4, 80)) == sorted(brute(rows, 4, 80), key=str)


def test_repeated_and_missing_ids_and_empty_table(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (9, "A B c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(N.near_duplicates(df)) == sorted([(5, 2, 5, True), (5, 2, 5, True), (None, 2, None, True), (9, 2, 5, False)], key=str)
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_loose_copies_of_one_text_are_not_paired_with_each_other(spark, monkeypatch):
    """Copies that each differ from the next by about four parts in ten: sketches can't tell such pairs from links, whole sets can."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(1, 161):
        copy = list(base)
        for k in rng.sample(range(400), 2 if i % 8 == 0 else 14):
            copy[k] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(copy)))
    pairs, stage = [], N.stage

    def counted(df, label):
        out = stage(df, label)
        if label == "pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(N, "stage", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(N.near_duplicates(df, 4, 80)) == sorted(brute(rows, 4, 80), key=str)
    assert pairs[0] < 10 * len(rows)
