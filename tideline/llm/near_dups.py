"""Near-duplicate documents by bottom-k sketches of one hash function.

A sketch is the k least hashes of a document's shingles. Documents with the same shingles are one class. Of a
class's retained values only its rarest enter the inverted lists: as two linked documents share at least `need` of
their k retained values, any k - need + 1 of one document's meet the other's, in whatever order both rank them, and
ranking by rarity keeps passages that many documents share out of the lists. Neighbours in these lists are joined
first, filtered by sketches of the union and confirmed on full shingle sets.

What a list still holds unjoined is searched by full sets, since sketches of many loose copies of one text can't be told
from those of linked ones and would pair all of them. The shingles of every such set are put in one order, roughly
the rarest first: of two linked sets of n and m the first shingle they share is the i-th of one and the j-th of the
other, and as they share at least percent / (100 + percent) of n + m, no fewer may follow it in either. Each set enters
the lists of its first shingles only, with how many follow, and pairs that can't reach that number are never emitted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from . import arrowtext
from .common import drop, small, small_batches, stage
from .components import components

K = 64
NEED = 33  # at similarity 0.8 a pair shares fewer of 64 retained values with a chance of about one in ten million
BLOCK = 256
PAIRS_AT_ONCE = 500_000
BUCKETS, SEGMENT = 1 << 19, 2048  # counters of shingles by their lower bits, and how many of them are one row
SALT_ROWS = 4096  # members of an inverted list that are ranked by one task
FIRST_PARTNERS = 3
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingle_sets(values: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes (63 bits) of its runs of `width` words, ASCII letters in lower case.

    A text with fewer words has its whole sequence as one shingle; a text without words has none.
    """
    distinct, codes, offsets = arrowtext.words(values)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(w.encode().lower()) for w in distinct.to_pylist()), np.uint64, len(distinct))[codes]
    joined = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        joined = (joined ^ hashes[k : k + len(joined)]) * _A
        joined ^= joined >> np.uint64(31)
        joined *= _B
    joined ^= joined >> np.uint64(29)
    joined >>= np.uint64(1)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= width:
            yield np.unique(joined[a : b - width + 1])
        elif b > a:
            yield np.array([xxhash.xxh3_64_intdigest(hashes[a:b].tobytes(), 1) >> 1], np.uint64)
        else:
            yield joined[:0]


def _digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _sketch_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrowtext.slices(batch):
                size, digest, sketch = [], [], []
                for s in shingle_sets(arrowtext.texts(part), width):
                    size.append(len(s))
                    digest.append(_digest(s))
                    sketch.append(s[:K].astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.list_(pa.int64())), *part.columns[2:]], ["doc_id", "n", "digest", "sketch", *part.schema.names[2:]])

    return run


def _set_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrowtext.slices(batch):
                digest, sets = [], []
                for s in shingle_sets(arrowtext.texts(part), width):
                    digest.append(_digest(s))
                    sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digest, pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "digest", "shingles"])

    return run


def needed(n: int) -> int:
    """Retained values that a document of n shingles shares with any document it is linked with."""
    return min(NEED, math.ceil(0.8 * min(n, K)))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles fall into each bucket, over all of a task's sets."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        flat = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u8")
        total += np.bincount((flat & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    if total.any():
        rows = total.astype("<u4").reshape(-1, SEGMENT)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows)), pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], ["segment", "counts"])


def _sum_counts(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c, "<u4").astype(np.uint64) for c in rows.column("counts").to_pylist())
    return pa.table({"segment": rows.column("segment")[:1], "counts": pa.array([np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary())})


def _weights(sets: DataFrame) -> np.ndarray:
    """About how often the shingles of each bucket occur in the sets: an order of shingles, of bounded size however many."""
    counted = sets.select("shingles").mapInArrow(arrowtext.trimmed(_count_batches), "segment long, counts binary").groupBy("segment").applyInArrow(_sum_counts, "segment long, counts binary")
    out = np.zeros((BUCKETS // SEGMENT, SEGMENT), np.uint32)
    for row in counted.collect():
        out[row.segment] = np.frombuffer(row.counts, "<u4")
    return out.ravel()


def _prefix_batches(weights: np.ndarray, percent: int):
    """Of each set the first shingles in the common order, one of which any linked set shares, and how many are left from each on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, left, sizes = [], [], []
            for data in batch.column(2).to_pylist():
                x = np.frombuffer(data, "<u8")
                weight = weights[x & np.uint64(BUCKETS - 1)]
                order = np.argsort(weight, kind="stable")[: len(x) - (percent * len(x) + 99) // 100 + 1]
                at = np.flatnonzero(weight[order] > 1)  # no other set has what is alone in its bucket
                values.append(x[order[at]].astype(np.int64)), left.append(len(x) - at), sizes.append(len(x))
            row = np.repeat(np.arange(batch.num_rows), list(map(len, values)))
            columns = [np.concatenate(values), np.concatenate(left), np.array(sizes)[row]] if values else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), *(pa.array(c, pa.int64()) for c in columns)], ["id", "mark", "value", "left", "n"])

    return run


def _block_pairs(percent: int):
    """Pairs of unlike label, within and between two blocks of a list, that can share enough shingles; near: the more can be shared, the greater."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column(0), batch.column(1)
            alone = two.is_null().to_numpy(zero_copy_only=False)
            members = pa.concat_arrays([one.values, two.values])
            doc, tag, n, left, mark = (x.to_numpy() for x in (members.field("id").field("doc"), members.field("id").field("tag"), members.field("n"), members.field("left"), members.field("mark")))
            bounds, others = one.offsets.to_numpy().astype(np.int64), two.offsets.to_numpy().astype(np.int64)
            a, a_size = bounds[:-1], np.diff(bounds)
            b, b_size = np.where(alone, a, others[:-1] + len(one.values)), np.where(alone, a_size, np.diff(others))
            cells = np.cumsum(a_size * b_size)
            start = 0
            while start < len(a):
                base = cells[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(cells, base + PAIRS_AT_ONCE, side="right")))
                size = (a_size * b_size)[start:end]
                row = np.repeat(np.arange(start, end), size)
                cell = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                i, j = a[row] + cell // b_size[row], b[row] + cell % b_size[row]
                small, large, total = np.minimum(n[i], n[j]), np.maximum(n[i], n[j]), n[i] + n[j]
                good = (mark[i] != mark[j]) & (100 * small >= percent * large) & ((100 + percent) * np.minimum(left[i], left[j]) >= percent * total) & (~alone[row] | (i < j))
                i, j, total = i[good], j[good], total[good]
                after = (doc[i] > doc[j]) | (doc[i] == doc[j]) & (tag[i] > tag[j])
                ends = [pa.StructArray.from_arrays([pa.array(x[np.where(first, i, j)]) for x in (doc, tag)], ["doc", "tag"]) for first in (after, ~after)]
                yield pa.RecordBatch.from_arrays([*ends, pa.array((left[i] + left[j]) / total)], ["u", "v", "near"])
                start = end

    return run


def _estimate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether the sketch of the union shows enough of it in both: of the k least of two sketches together, those in both."""
    for batch in batches:
        keep = []
        for a, b, n, m in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
            both = np.sort(np.concatenate([np.array(a, np.int64), np.array(b, np.int64)]))
            twice = np.concatenate([both[1:] == both[:-1], [False]])
            first = np.concatenate([[True], both[1:] != both[:-1]])
            keep.append(int(twice[first][:K].sum()) >= needed(min(n, m)))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(mask)


def _confirm_batches(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _joined(pairs: DataFrame, side: DataFrame, *columns: str) -> DataFrame:
    """The columns of both ends of each pair, named a_ and b_."""
    for end, prefix in (("u", "a_"), ("v", "b_")):
        pairs = pairs.join(side.select(F.col("id").alias(end), *[F.col(c).alias(prefix + c) for c in columns]), end)
    return pairs


def _absorbed(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links: components of the labels that the links join, nothing is solved anew."""
    ends = links
    for end in ("u", "v"):
        ends = ends.join(labels.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label")), end, "left")
    joined = stage(components(ends.select(F.coalesce("u_label", "u").alias("u"), F.coalesce("v_label", "v").alias("v"))), "joined")
    moved = labels.join(joined.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    out = stage(moved.unionByName(joined.join(labels, "id", "left_anti")), "labels")
    drop(joined)
    drop(labels)
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, component_tag and the columns `keep` for every row.

    Rows are linked where 100 * |A and B| >= percent * |A or B| of their shingle sets (percent 80 and more);
    component_id is the least doc_id that can be reached, kept whether that is the row's own. A null or empty text,
    or one of white space alone, has no shingles and no link. Rows that repeat a doc_id are each returned and each
    linked by its own text: with the same component if their texts agree, else each with that of its own links
    (component_tag tells such components of one component_id apart). A row without doc_id takes no part: its component
    is null and it is kept. Columns not in `keep`, which must not have our names, are ignored.

    A class of equal sets of any size is one member of the search; it is known by its least doc_id and a tag of its
    digest. A list of any length is spread over salts, cut into blocks of bounded size, and blocks meet pairwise if
    the sizes of their documents allow a link, after links between neighbours have joined what is alike; nothing is
    emitted for pairs that are joined already, nor for those whose sets can't overlap enough.
    """
    spark = docs.sparkSession
    small_batches(spark)
    clean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    node = "struct<doc: bigint, tag: bigint>"
    carried = "".join(f", `{c}` {clean.schema[c].dataType.simpleString()}" for c in keep)
    all_ = stage(clean.mapInArrow(arrowtext.trimmed(_sketch_batches(width)), f"doc_id long, n long, digest binary, sketch array<long>{carried}"), "sketches")
    usable = all_.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    tag = F.xxhash64("digest")
    classes = usable.groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    reps = stage(classes.select("digest", F.struct("doc", tag.alias("tag")).alias("id"), "n", "sketch"), "classes")

    # Inverted lists of the rarest retained values. A value that one class alone retains finds nothing, but counts as rarest.
    values = reps.select("id", "n", F.explode("sketch").alias("value"))
    often = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    common = values.join(often, "value")
    kept = F.least(F.col("n"), F.lit(K))
    need = F.least(F.lit(NEED), F.ceil(F.lit(0.8) * kept))
    by_id = Window.partitionBy("id")
    rank = kept - F.count(F.lit(1)).over(by_id) + F.row_number().over(by_id.orderBy("df", "value"))
    salts = F.ceil(F.col("df") / SALT_ROWS)
    ranked = common.withColumn("rank", rank).where(F.col("rank") <= kept - need + 1)
    lists = stage(ranked.select("value", "id", "n", F.pmod(F.xxhash64("id"), salts).alias("salt"), salts.alias("salts")), "lists")

    members = stage(lists.select("id.doc").distinct(), "members")
    texts = clean.select("doc_id", "text").join(small(members).withColumnRenamed("doc", "doc_id"), "doc_id", "left_semi")
    found_sets = texts.mapInArrow(arrowtext.trimmed(_set_batches(width)), "doc_id long, digest binary, shingles binary")
    sets = stage(found_sets.select(F.struct(F.col("doc_id").alias("doc"), tag.alias("tag")).cast(node).alias("id"), "shingles").dropDuplicates(["id"]), "sets")
    drop(members)

    def confirmed(pairs: DataFrame) -> DataFrame:
        chosen = _joined(pairs.select("u", "v"), sets, "shingles").select("u", "v", "a_shingles", "b_shingles")
        return stage(chosen.mapInArrow(arrowtext.trimmed(_confirm_batches(percent)), f"u {node}, v {node}"), "links")

    # First, neighbours in each list by size: what is alike is soon joined.
    order = Window.partitionBy("value", "salt").orderBy("n", "id")
    near = lists.withColumn("next", F.lead("id").over(order)).withColumn("next_n", F.lead("n").over(order)).where(F.col("next").isNotNull() & (F.col("n") * 100 >= F.col("next_n") * 80))
    first = near.select(F.greatest("id", "next").alias("u"), F.least("id", "next").alias("v")).distinct()
    estimated = _joined(first, reps, "sketch", "n").select("u", "v", "a_sketch", "b_sketch", "a_n", "b_n").mapInArrow(arrowtext.trimmed(_estimate_batches), f"u {node}, v {node}")
    links = confirmed(estimated)
    labels = stage(components(links), "labels")
    drop(links)

    # Then every pair that is not joined yet, of the documents that share a list with one of another label.
    told = lists.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = told.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("value")
    open_ = stage(told.join(mixed, "value", "left_semi").groupBy("id").agg(F.xxhash64(F.first("label")).alias("mark")), "open")
    drop(lists)
    weights = _weights(sets)
    first_ones = sets.join(small(open_), "id").select("id", "mark", "shingles").mapInArrow(arrowtext.trimmed(_prefix_batches(weights, percent)), f"id {node}, mark long, value long, left long, n long")
    entries = stage(first_ones, "entries")
    drop(open_)
    mixed = entries.groupBy("value").agg(F.min("mark").alias("low"), F.max("mark").alias("high"), F.ceil(F.count(F.lit(1)) / SALT_ROWS).alias("salts")).where("low <> high").select("value", "salts")
    placed = entries.join(mixed, "value").withColumn("salt", F.pmod(F.xxhash64("id"), "salts")).withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK))
    side = F.collect_list(F.struct("id", "n", "left", "mark")).alias("side")
    blocks = stage(placed.groupBy("value", "salt", "salts", "block").agg(side, F.min("n").alias("low"), F.max("n").alias("high")), "blocks")
    drop(entries)
    a, b = blocks.alias("a"), blocks.withColumn("meets", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).alias("b")
    allowed = (F.col("a.low") * 80 <= F.col("b.high") * 100) & (F.col("b.low") * 80 <= F.col("a.high") * 100)
    once = F.struct("a.salt", "a.block") < F.struct("b.salt", "b.block")
    met = a.join(b, (F.col("a.value") == F.col("b.value")) & (F.col("a.salt") == F.col("b.meets")) & once & allowed).select(F.col("a.side").alias("left"), F.col("b.side").alias("right"))
    alone = blocks.select(F.col("side").alias("left"), F.lit(None).cast(blocks.schema["side"].dataType).alias("right"))
    pairs = stage(met.unionByName(alone).mapInArrow(arrowtext.trimmed(_block_pairs(percent)), f"u {node}, v {node}, near double").groupBy("u", "v").agg(F.max("near").alias("near")), "pairs")
    drop(blocks)
    if pairs.limit(1).count():
        # The likeliest partners first: most of the rest is joined by then and need not be confirmed.
        ends = pairs.withColumn("end", F.explode(F.array("u", "v")))
        best = ends.withColumn("rank", F.row_number().over(Window.partitionBy("end").orderBy(F.desc("near"), "u", "v"))).where(F.col("rank") <= FIRST_PARTNERS).select("u", "v").distinct()
        second = confirmed(best)
        labels = _absorbed(labels, second)
        left = pairs.select("u", "v").join(best, ["u", "v"], "left_anti")
        for end in ("u", "v"):
            left = left.join(labels.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label")), end, "left")
        third = confirmed(left.where(F.coalesce("u_label", "u") != F.coalesce("v_label", "v")))
        if third.limit(1).count():
            labels = _absorbed(labels, third)
        drop(second)
        drop(third)
    drop(pairs)
    drop(sets)

    found = all_.select("doc_id", "n", "digest", *keep).join(reps.select("digest", "id"), "digest", "left").join(labels, "id", "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("label.doc", "id.doc"))
    kept_row = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept_row.alias("kept"), F.coalesce("label.tag", "id.tag").alias("component_tag"), *keep)
