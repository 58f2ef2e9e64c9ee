"""Substring deduplication by content-defined chunks, with exact ends.

A gear hash of the last 16 bytes is read at the end of every word; of every 8 words in a row the one with the least
hash ends a chunk. So cuts depend on what stands near them and on nothing else, chunks are 8 words long at most, and an
insertion shifts none but those it touches: a passage of 50 words always holds two chunks in a row that are cut alike
wherever it stands. Digests of such pairs are deduplicated over all documents, each batch of documents asking about each
of its digests once. Around pairs that several documents hold, windows of as many words as a passage has at least are
deduplicated in the same way; they give the passages' ends to the word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import arrowtext
from .common import drop, only, small_batches, stage

CUT_WORDS = 8  # of so many words in a row the one of least hash ends a chunk; a power of two
MARGIN = 24  # words that a passage can reach over its first or last certain pair: 16 bytes of other context, and twice CUT_WORDS
LEAST_WORDS = 50  # passages shorter than that may hold no certain pair
BUCKET_KEYS = 2_000_000
_GEAR = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=2).digest() for b in range(256)), "<u2")
_MIX, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=8, person=b"window").digest() for b in range(256)), "<u8")
_BASE, _INVERSE = np.uint64(0xF1357AEA2E62A9C5), np.uint64(pow(0xF1357AEA2E62A9C5, -1, 1 << 64))
_POWERS = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after every byte: the sum of gear[byte k back] << k in 16 bits, which has forgotten what lies 16
    bytes back; built by doubling."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        moved = h[:-step] << np.uint16(step)
        h[step:] = h[step:] + moved
    return h


def cuts(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The words that end a chunk: in each run of CUT_WORDS words of a text the last of those with the least hash."""
    n = len(hashes)
    least = (hashes.astype(np.int64) << 40) | (n - np.arange(n))
    for k in range(CUT_WORDS.bit_length() - 1):
        step = 1 << k
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
    inside = text[: len(least)] == text[CUT_WORDS - 1 :] if len(least) else np.zeros(0, bool)
    return np.unique(n - (least[inside] & ((1 << 40) - 1)))


def _joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each a followed by its b; which is first matters."""
    h = (a ^ (a >> np.uint64(31))) * _ODD + b
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)])) for x in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text of all words of texts that stand one after the other in data."""
    blank = np.concatenate([[True], (data == 32) | ((data >= 9) & (data <= 13)), [True]])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(~blank[1:-1] & (blank[:-2] | edge[:-1]))
    ends = np.flatnonzero(~blank[1:-1] & (blank[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def chunk_pairs(data: np.ndarray, ends: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every two chunks of a text in a row: the first word, the last word, and the digest of both in order."""
    at = cuts(gear(data)[ends - 1], text) if len(ends) else np.zeros(0, np.int64)
    if len(at) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)])
    end = ends[at]
    chunk = _joint((total[end[1:]] - total[end[:-1]]) * down[end[:-1]], (end[1:] - end[:-1]).astype(np.uint64))
    one = np.flatnonzero(text[at[:-2]] == text[at[2:]])
    return at[one] + 1, at[one + 2], _joint(chunk[one], chunk[one + 1])


def windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every `least` words of one text in a row, with the white space between them: the place of the first and their digest."""
    if len(starts) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)])
    bare = _joint((total[ends] - total[starts]) * down[starts], (ends - starts).astype(np.uint64))
    after = np.append(starts[1:], len(data))
    unit = _joint(bare, _joint((total[after] - total[ends]) * down[ends], (after - ends).astype(np.uint64)))
    run, have, size, rest = None, 0, 1, least - 1  # the first words with what follows them, by doubling
    while rest:
        if rest & 1:
            n = len(unit) - have
            run = unit if run is None else _joint(run[:n], unit[have:])
            have += size
        rest >>= 1
        if rest:
            unit = _joint(unit[:-size], unit[size:])
            size *= 2
    n = len(starts) - least + 1
    key = bare if run is None else _joint(run[:n], bare[least - 1 :])
    place = np.flatnonzero(text[:n] == text[least - 1 :])
    return place, key[place]


def covered_runs(first: np.ndarray, last: np.ndarray, text: np.ndarray, margin: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last words of the runs, each within one text, of words that lie between first and last or within margin of them."""
    n = len(text)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.maximum(first - margin, 0), 1)
    np.add.at(edge, np.minimum(last + 1 + margin, n), -1)
    inside = np.cumsum(edge)[:n] > 0
    other = text[1:] != text[:-1]
    head = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1] | other])) if n else np.zeros(0, np.int64)
    tail = np.flatnonzero(inside & np.concatenate([~inside[1:] | other, [True]])) if n else np.zeros(0, np.int64)
    return head, tail


def known(keys: np.ndarray, found: list[bytes]) -> np.ndarray:
    """Which keys are among those found."""
    told = np.sort(np.concatenate([np.frombuffer(f, "<u8") for f in found])) if found else np.zeros(0, np.uint64)
    if not len(told):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(told, keys), len(told) - 1)
    return told[at] == keys


# --- the exchange -------------------------------------------------------------------------------------------

REGIONS = "grp string, ids array<long>, data binary, offsets binary, owner array<long>, base array<long>"
STAGED = "grp string, ids array<long>, data binary, offsets binary, windows long"


def _text_batches():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in arrowtext.slices(batch, limit=4_000_000):
                values = arrowtext.texts(part)
                offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
                data = values.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if values.buffers()[2] is not None else b""
                most = data.count(b" ") + sum(data.count(bytes([b])) for b in range(9, 14)) + len(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{task}-{serial}"]), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([data], pa.binary()), pa.array([(offsets - offsets[0]).astype("<i8").tobytes()], pa.binary()), pa.array([most], pa.int64())],
                    ["grp", "ids", "data", "offsets", "windows"],
                )
                serial += 1

    return run


def _asked(grp: str, key: np.ndarray, text: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A group's distinct keys by bucket, with a bit for those that two of its own documents hold."""
    order = np.lexsort((text, key))
    key, text = key[order], text[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    last = np.append(head[1:], len(key)) - 1
    several = text[head] != text[last]
    key = key[head]
    bucket = (key >> np.uint64(40)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    key, several, bucket = key[order], several[order], bucket[order]
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(key) else np.zeros(0, np.int64)
    ends = np.append(edge[1:], len(key))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[edge].astype(np.int32)),
            pa.array([grp] * len(edge), pa.string()),
            pa.array([key[a:b].tobytes() for a, b in zip(edge, ends)], pa.binary()),
            pa.array([several[a:b].tobytes() for a, b in zip(edge, ends)], pa.binary()),
        ],
        ["bucket", "grp", "keys", "several"],
    )


def _group(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = np.frombuffer(row["data"], np.uint8), np.frombuffer(row["offsets"], "<i8")
    return data, offsets, *words(data, offsets)


def _ask_pairs(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, _, _, ends, text = _group(row)
                first, _, key = chunk_pairs(data, ends, text)
                yield _asked(row["grp"], key, text[first], buckets)

    return run


def _region_batches(least: int):
    """What lies around the pairs that several documents hold, if it is long enough for a passage: each stretch with its
    document and the place of its first byte there. The rest of the texts is not needed any more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, offsets, starts, ends, text = _group(row)
                first, last, pair = chunk_pairs(data, ends, text)
                held = known(pair, row["found"])
                head, tail = covered_runs(first[held], last[held], text, MARGIN)
                long = tail - head + 1 >= least
                head, tail = head[long], tail[long]
                if not len(head):
                    continue
                begin, size, owner = starts[head], ends[tail] - starts[head], text[head]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["grp"]]),
                        pa.array([[row["ids"][t] for t in owner.tolist()]], pa.list_(pa.int64())),
                        pa.array([arrowtext.ragged(data, begin, size).tobytes()], pa.binary()),
                        pa.array([np.concatenate([[0], np.cumsum(size)]).astype("<i8").tobytes()], pa.binary()),
                        pa.array([owner], pa.list_(pa.int64())),
                        pa.array([begin - offsets[owner]], pa.list_(pa.int64())),
                    ],
                    ["grp", "ids", "data", "offsets", "owner", "base"],
                )

    return run


def _ask_windows(buckets: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, _, starts, ends, text = _group(row)
                place, key = windows(data, starts, ends, text, least)
                yield _asked(row["grp"], key, np.array(row["owner"])[text[place]], buckets)

    return run


def _answer_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each group of a partition's buckets, those of its keys that two documents hold."""
    groups, keys, several = [], [], []
    for batch in batches:
        groups += batch.column(1).to_pylist()
        keys += [np.frombuffer(k, "<u8") for k in batch.column(2).to_pylist()]
        several += [np.frombuffer(s, bool) for s in batch.column(3).to_pylist()]
    if not groups:
        return
    size = np.array([len(k) for k in keys])
    key, owner, many = np.concatenate(keys), np.repeat(np.arange(len(groups)), size), np.concatenate(several)
    order = np.argsort(key, kind="stable")
    key, owner, many = key[order], owner[order], many[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(head, len(key)))
    repeats = np.repeat((count > 1) | np.logical_or.reduceat(many, head), count)
    key, owner = key[repeats], owner[repeats]
    order = np.argsort(owner, kind="stable")
    key, owner = key[order], owner[order]
    for i in np.unique(owner):
        a, b = np.searchsorted(owner, [i, i + 1])
        yield pa.RecordBatch.from_arrays([pa.array([groups[i]]), pa.array([key[a:b].tobytes()], pa.binary())], ["grp", "found"])


def _span_batches(least: int):
    """Of each document, the runs of words in repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, offsets, starts, ends, text = _group(row)
                place, key = windows(data, starts, ends, text, least)
                hit = place[known(key, row["found"])]
                out: dict[int, tuple[int | None, list[tuple[int, int, int]]]] = {}
                for a, b in zip(*covered_runs(hit, hit + least - 1, text, 0)):
                    t = text[a]
                    shift = row["base"][t] - int(offsets[t])
                    out.setdefault(row["owner"][t], (row["ids"][t], []))[1].append((int(starts[a]) + shift, int(ends[b]) + shift, int(b - a + 1)))
                rows = [(i, len(s), sum(w for *_, w in s), sum(b - a for a, b, _ in s), ",".join(f"{a}:{b}" for a, b, _ in s)) for _, (i, s) in sorted(out.items())]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.string() if c == 4 else pa.int64()) for c in range(5)], ["doc_id", "n_spans", "n_words", "n_bytes", "spans"])

    return run


def repeated_passages(docs: DataFrame, least_words: int = 50) -> DataFrame:
    """Documents with passages that other documents hold too: doc_id, n_spans, n_words, n_bytes, spans (start:end in bytes).

    A passage is `least_words` whole words and more in a row, with the same white space between them, from the start of
    its first word to the end of its last; every such passage is found, whatever its bytes. Passages that touch or
    overlap in a document are one span. Every document that holds a passage is listed, the first too; documents without
    one are not. What repeats within one document alone is no repetition. Null and empty texts have no passages;
    repeated rows repeat each other if they are long enough; a null doc_id is listed as null; other columns are ignored.

    Candidates are found by chunks, ends by windows (see above). Digests have 64 bits: that two of 10^9 unlike windows agree has a chance of about 3 %. Memory: a group of documents
    of 4 MB, or a bucket of about BUCKET_KEYS keys, at a time; a digest of a third of all documents is one key of each
    group.
    """
    if least_words < LEAST_WORDS:
        raise ValueError(f"passages of fewer than {LEAST_WORDS} words may hold no pair of chunks that is cut alike everywhere")
    spark = docs.sparkSession
    small_batches(spark)
    staged = stage(only(docs, doc_id="long", text="string").mapInArrow(_text_batches(), STAGED), "texts")
    keys = staged.agg(F.sum("windows")).collect()[0][0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), keys // BUCKET_KEYS + 1)
    asks = "bucket int, grp string, keys binary, several binary"

    def answered(asked: DataFrame) -> DataFrame:
        found = asked.repartitionById(buckets, F.col("bucket")).mapInArrow(_answer_batches, "grp string, found binary")
        return stage(found.groupBy("grp").agg(F.collect_list("found").alias("found")), "answers")

    pairs = answered(staged.select("data", "offsets", "grp").mapInArrow(_ask_pairs(buckets), asks))
    near = staged.select("ids", "data", "offsets", "grp").join(pairs, "grp")
    regions = stage(near.mapInArrow(_region_batches(least_words), REGIONS), "regions")
    drop(staged)
    drop(pairs)
    answers = answered(regions.select("data", "offsets", "grp", "owner").mapInArrow(_ask_windows(buckets, least_words), asks))
    return regions.join(answers, "grp").mapInArrow(_span_batches(least_words), "doc_id long, n_spans long, n_words long, n_bytes long, spans string")
