"""Benchmark decontamination: every passage of the corpus queries a BM25 index of test items by block-max WAND.

An item's score by a passage is the share of the item's own BM25 weight that the passage's words hold, 0 to 1; all
items at or above the threshold are retrieved. Passages are windows of words that overlap by half and are twice as
long as the longest item, so that each place where an item can stand lies whole in one of them. Before a passage is
searched, bounds over blocks of items rule out whole passages many at a time: the same block maxima, summed for all
passages of a batch at once. What is retrieved is then verified: the shares of the item's question and of its answer
that stand in the passage as runs of five words.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import arrowtext
from .common import only, small_batches

K1, B = 1.2, 0.75
POSTING_BLOCK = 8
BOUND_COLUMNS = 48
SHARD_BYTES = 16 << 20
_TRIM = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def normal(word: str) -> str:
    """A word without what is no letter or digit."""
    return word if word.isalnum() else _TRIM.sub("", word)


def words_of(text: str) -> list[str]:
    return [w for w in map(normal, text.lower().split()) if w]


def folded(values: pa.Array) -> pa.Array:
    """Texts whose split at ASCII white space gives the words of words_of: plain ASCII by Arrow, the others by Python's own rules."""
    odd = pc.match_substring_regex(values, r"[^\t-\r -~]")
    if pc.any(odd).as_py():
        values = pc.replace_with_mask(values, odd, pa.array([" ".join(t.lower().split()) for t in values.filter(odd).to_pylist()], values.type))
    return pc.ascii_lower(values)


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's question and answer: its last sentence or line answers the rest; of a single one, its last quarter."""
    parts = [w for w in map(words_of, _SENTENCE.split(text)) if w]
    if not parts:
        return [], []
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    cut = len(parts[0]) - max(1, len(parts[0]) // 4)
    return parts[0][:cut], parts[0][cut:]


def runs(words: list[str], width: int) -> set[tuple[str, ...]]:
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if width else set()


class Statistics:
    """What scores and windows need of all items, however these are cut into shards."""

    def __init__(self, texts: Iterable[str]):
        self.items = self.words = self.longest = 0
        self.df: Counter[str] = Counter()
        for words in filter(None, map(words_of, texts)):
            self.items += 1
            self.words += len(words)
            self.longest = max(self.longest, len(words))
            self.df.update(set(words))

    def idf(self, term: str) -> float:
        n = self.df[term]
        return math.log(1 + (self.items - n + 0.5) / (n + 0.5))


class ItemIndex:
    """Postings with weights normalized by item, block maxima within postings, and maxima over blocks of items."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = 0.5, width: int = 5, over: Statistics | None = None):
        self.threshold, self.width = threshold, width
        over = over or Statistics(t for _, t in items)
        split = [(i, t, words_of(t)) for i, t in items]
        split = [x for x in split if x[2]]
        self.ids = [i for i, _, _ in split]
        self.parts = [question_and_answer(t) for _, t, _ in split]
        self.longest, mean = over.longest, over.words / max(1, over.items)
        own_terms = sorted({t for *_, w in split for t in w})
        idf = {t: over.idf(t) for t in own_terms}
        self.terms = {t: k for k, t in enumerate(own_terms)}
        self.postings: list[tuple[list[int], list[float]]] = [([], []) for _ in self.terms]
        columns = min(BOUND_COLUMNS, max(1, len(split)))
        self.edges = [-(-c * len(split) // columns) for c in range(columns + 1)]  # column c bounds the items edges[c] to edges[c + 1]
        self.bounds = np.zeros((len(self.terms), columns), np.float32)
        for n, (*_, w) in enumerate(split):
            raw = {t: idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in Counter(w).items()}
            own = sum(raw.values())
            for t, x in sorted(raw.items()):
                term = self.terms[t]
                self.postings[term][0].append(n)
                self.postings[term][1].append(x / own)
                cell = n * columns // len(split)
                self.bounds[term, cell] = max(self.bounds[term, cell], x / own)
        self.most = [max(x) for _, x in self.postings]
        self.block_most = [[max(x[i : i + POSTING_BLOCK]) for i in range(0, len(x), POSTING_BLOCK)] for _, x in self.postings]

    def search(self, terms: list[int], start: int = 0, stop: int = 1 << 60) -> list[tuple[int, float]]:
        """Items from start to stop whose score by the distinct terms reaches the threshold, by block-max WAND.

        Cursors stand at items in order. The pivot is the first item at which the lists' maxima could reach the
        threshold; if the maxima of the blocks it falls in cannot, all cursors move behind the nearest block's end.
        """
        least = self.threshold - 1e-9
        cursors = []  # item, term, place
        for t in terms:
            ids = self.postings[t][0]
            at = bisect_left(ids, start)
            if at < len(ids) and ids[at] < stop:
                cursors.append([ids[at], t, at])
        out = []
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, (_, t, _) in enumerate(cursors):
                total += self.most[t]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, next_item = 0.0, 1 << 60
            for c in cursors[: pivot + 1]:
                ids = self.postings[c[1]][0]
                at = bisect_left(ids, item, c[2])
                if at == len(ids):
                    continue
                block = at // POSTING_BLOCK
                bound += self.block_most[c[1]][block]
                next_item = min(next_item, ids[min(len(ids), (block + 1) * POSTING_BLOCK) - 1] + 1)
            if bound < least:
                if pivot + 1 < len(cursors):
                    next_item = min(next_item, cursors[pivot + 1][0])
                target, moved = max(next_item, item + 1), cursors[: pivot + 1]
            elif cursors[0][0] == item:
                score = math.fsum(self.postings[t][1][p] for i, t, p in cursors[: pivot + 1])
                if score >= least:
                    out.append((item, score))
                target, moved = item + 1, cursors[: pivot + 1]
            else:
                target, moved = item, [c for c in cursors[:pivot] if c[0] < item]
            for c in moved:
                ids = self.postings[c[1]][0]
                c[2] = bisect_left(ids, target, c[2])
                c[0] = ids[c[2]] if c[2] < len(ids) and ids[c[2]] < stop else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return out

    def verify(self, item: int, passage: list[str]) -> tuple[float, float]:
        """Shares of the runs of the item's question and answer that stand in the passage; an empty part counts as found."""
        shares = []
        for part in self.parts[item]:
            wanted = runs(part, self.width)
            held = runs(passage, min(self.width, len(part))) if wanted else set()
            shares.append(len(wanted & held) / len(wanted) if wanted else 1.0)
        return shares[0], shares[1]


def window_starts(n: int, size: int) -> range:
    """Starts of windows of `size` words, half overlapping, that cover n words."""
    half = max(1, size // 2)
    return range(0, max(1, n - half), half)


def _hits(index: ItemIndex, texts: pa.Array, overlap: float) -> dict[tuple[int, int], tuple]:
    """The best verified passage of every text and item: (question overlap, answer overlap, score, -first word)."""
    best: dict[tuple[int, int], tuple] = {}
    if index.ids:
        distinct, codes, offsets = arrowtext.words(folded(texts))
        for i, item, score, question, answer, first in _matches(index, 2 * index.longest, distinct.to_pylist(), codes, offsets):
            if question >= overlap and answer >= overlap:
                best[i, item] = max(best.get((i, item), ()), (question, answer, score, -first))
    return best


def _query_batches(shared, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = shared.value
        for batch in batches:
            for part in arrowtext.slices(batch):
                hits = sorted(_hits(index, arrowtext.texts(part), overlap).items())
                ids = part.column(0).take(pa.array([i for (i, _), _ in hits], pa.int64()))
                rows = [(index.ids[item], round(h[2], 6), h[0], h[1], -h[3]) for (_, item), h in hits]
                kinds = (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)]], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

    return run


def _clean_batches(shared, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = shared.value
        for batch in batches:
            for part in arrowtext.slices(batch):
                keep = np.ones(part.num_rows, dtype=bool)
                keep[[i for i, _ in _hits(index, arrowtext.texts(part), overlap)]] = False
                yield part.filter(pa.array(keep))

    return run


def _matches(index: ItemIndex, size: int, distinct: list[str], codes: np.ndarray, offsets: np.ndarray):
    normals = list(map(normal, distinct))
    term = np.fromiter((index.terms.get(w, -1) if w else -2 for w in normals), np.int64, len(normals))[codes]
    real = term != -2
    offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
    codes, term = codes[real], term[real]
    # All windows of all texts: (text, first word, end).
    starts, ends, owner = [], [], []
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for s in window_starts(b - a, size) if b > a else ():
            starts.append(a + s), ends.append(min(b, a + s + size)), owner.append(i)
    if not starts:
        return
    starts, ends = np.array(starts), np.array(ends)
    place = np.flatnonzero(term >= 0)
    low, high = np.searchsorted(place, starts), np.searchsorted(place, ends)
    step = max(1, 400_000 * len(starts) // max(1, int((high - low).sum())))
    for w in range(0, len(starts), step):  # blocks of windows, so that the table of bounds stays small
        a, b = low[w : w + step], high[w : w + step]
        window = np.repeat(np.arange(len(a)), b - a)
        pair = np.unique(window * len(index.terms) + term[place[arrowtext.ragged(np.arange(len(place)), a, b - a)]])
        window, terms = pair // len(index.terms), pair % len(index.terms)
        head = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]])) if len(pair) else np.zeros(0, np.int64)
        if not len(head):
            continue
        bound = np.add.reduceat(index.bounds[terms], head, axis=0) >= index.threshold - 1e-4  # the bounds have 32 bits
        for k in np.flatnonzero(bound.any(axis=1)):
            last = head[k + 1] if k + 1 < len(head) else len(terms)
            v, own = w + int(window[head[k]]), terms[head[k] : last].tolist()
            passage = None
            for start, stop in _ranges(np.flatnonzero(bound[k]).tolist()):
                for item, score in index.search(own, index.edges[start], index.edges[stop]):
                    if passage is None:
                        passage = [normals[c] for c in codes[starts[v] : ends[v]].tolist()]
                    question, answer = index.verify(item, passage)
                    yield owner[v], item, score, question, answer, int(starts[v] - offsets[owner[v]])


def _ranges(columns: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of adjacent columns as (first, behind the last)."""
    at = 0
    for k in range(1, len(columns) + 1):
        if k == len(columns) or columns[k] != columns[k - 1] + 1:
            yield columns[at], columns[k - 1] + 1
            at = k


def _items(benchmark: DataFrame) -> DataFrame:
    return only(benchmark, item_id="long", text="string").where("text is not null")


def item_shards(benchmark: DataFrame, limit: int = SHARD_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Test items in lists of at most `limit` bytes of text, streamed to the driver one list at a time."""
    held, size = [], 0
    for r in _items(benchmark).orderBy("item_id", "text").toLocalIterator():
        held.append((r.item_id, r.text))
        size += len(r.text.encode())
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _indexes(benchmark: DataFrame, threshold: float, width: int) -> Iterator:
    """Broadcast indexes of all shards, with the statistics of all items."""
    spark = benchmark.sparkSession
    small_batches(spark)
    over = Statistics(r.text for r in _items(benchmark).select("text").toLocalIterator())
    for shard in item_shards(benchmark):
        yield spark.sparkContext.broadcast(ItemIndex(shard, threshold, width, over))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.8, width: int = 5) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, first_word of every row that holds a test item; no shuffle.

    All pairs are reported whose BM25 share reaches `threshold` in some passage and of whose question `overlap` of
    the runs of `width` words, and as much of the answer, stand in that passage; of several passages the best.
    Rows without a match are not listed. Null and empty texts match nothing, nor do items without words; equal
    items, repeated rows and rows without doc_id are each reported; other columns are ignored.

    Document frequencies, mean length and window size are of all items. Indexes are broadcast, each over at most
    SHARD_BYTES of items; a larger benchmark takes one pass a shard, with the same scores. The driver holds the
    frequencies of the items' words and one shard.
    """
    clean = only(docs, doc_id="long", text="string")
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
    found = [clean.mapInArrow(_query_batches(index, overlap), schema) for index in _indexes(benchmark, threshold, width)]
    return reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], schema)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.8, width: int = 5) -> DataFrame:
    """The rows of docs, all columns, that hold no test item in the sense of `contaminated`; no shuffle, nothing is joined.

    Every row is judged by its own `text`, a string column, whatever its doc_id; null and empty texts stay.
    """
    for index in _indexes(benchmark, threshold, width):
        docs = docs.mapInArrow(arrowtext.trimmed(_clean_batches(index, overlap)), docs.schema)
    return docs
