"""Content-addressed store of token ids.

Every document's id stream is cut where a rolling hash of the last ids says so; each distinct chunk is
stored once under its digest; a document is a recipe of digests with the root of their Merkle tree; parts
of the recipe table have manifests with the root over their documents. Reading recomputes every digest and
root from the stored bytes.

Files, all Parquet under one path:
  kind=0/     chunks: key (digest), n (ids), body (little-endian ids of `width` bytes)
  kind=1/     recipes in ascending doc_id order, file by file: doc_id, part, n, key (Merkle root), body (digests)
  manifest/   part, first_doc, last_doc, n_docs, n_tokens, start (ids before the part), root
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from . import arrowtext
from .common import new_path, only, small_batches
from .token_counts import byte_letters

DIGEST = 16
LEAST, MOST, CUT_BITS = 64, 1024, 8  # ids in a chunk: 64 at least, 1024 at most, a cut at one place of 256 between
CACHED_PIECES = 600_000  # in each of two generations
SLICE_BYTES = 24_000_000
SUSPECT = r"[^\t\n\r -~\p{L}\p{M}\p{N}\p{P}\p{S}]|<\||Σ"  # what Arrow's tables don't know to be plain; Python's decide
MARK = "\x00"
SEEN_CHUNKS = 200_000


# --- encoding -----------------------------------------------------------------------------------------------


class SegmentEncoder:
    """Ids of whole texts by the tokenizers library, each distinct piece of a text encoded once.

    For files with NORMALIZER and PRE_TOKENIZER, which drop white space and work letter by letter, a text's ids are
    those of its space-separated segments in order, and a segment's are those of its pre-tokens. The segments of a slice
    are folded and cut by one call; the model sees only pieces it hasn't met lately.
    With any other file, and for segments that hold what the rules don't cover, the library encodes the whole.
    """

    PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    PRE_TOKENIZER = {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": PRETOKEN}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    }

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        self.regular = rules["normalizer"] == self.NORMALIZER and rules["pre_tokenizer"] == self.PRE_TOKENIZER
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 0x10000 else "<u4")
        self.letters = byte_letters()
        # Segments are joined by a mark that no regular segment holds; it is a piece of its own, without ids.
        self.any = regex.compile(f"{MARK}|" + self.PRETOKEN.replace(r"[^\s\p{L}\p{N}]", rf"[^\s\p{{L}}\p{{N}}{MARK}]"))
        self.breaks = dict.fromkeys(map(ord, "\t\n\r"))
        self.pieces = arrowtext.Recent(CACHED_PIECES)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def odd(self, s: str) -> bool:
        """Special strings, control characters, and letters whose case depends on their place."""
        return "<|" in s or "Σ" in s or not s.isprintable() and not s.translate(self.breaks).isprintable()

    def _learn(self, words: set[str]) -> None:
        self.pieces.recall([])
        young, old = self.pieces, self.pieces.old
        for word in words.difference(young):
            known = old.get(word)
            if known is None:
                spelled = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
                known = array(self.dtype.char, [t.id for t in self.model.tokenize(spelled)]).tobytes()
            young[word] = known
        young[MARK] = b""

    def _ids(self, segments: list[str]) -> list[bytes]:
        """Ids of regular segments."""
        joined = MARK.join(segments) + MARK
        found = self.any.findall((joined if joined.isascii() else unicodedata.normalize("NFC", joined)).lower())
        self._learn(set(found))
        pool = list(map(self.pieces.__getitem__, found))
        size = np.fromiter(map(len, pool), np.int64, len(pool))
        flat, ends = b"".join(pool), np.cumsum(size)[size == 0].tolist()  # every piece but the mark has an id
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, values: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other and each closed by `end`, and the offsets of the texts."""
        distinct, codes, offsets = arrowtext.segments(values)
        found = distinct.to_pylist()
        if self.regular:
            odd = [i for i in np.flatnonzero(pc.match_substring_regex(distinct, SUSPECT).to_numpy(zero_copy_only=False)).tolist() if self.odd(found[i])]
            wholes = [self.whole(found[i]) for i in odd]
            for i in odd:
                found[i] = ""
            pool = self._ids(found)
            for i, ids in zip(odd, wholes):
                pool[i] = ids
        else:
            pool = list(map(self.whole, found))
        last, each, bounds = np.array([end], self.dtype).tobytes(), codes.tolist(), offsets.tolist()
        texts = [b"".join(map(pool.__getitem__, each[a:b])) + last for a, b in zip(bounds, bounds[1:])]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) // self.dtype.itemsize
        return np.frombuffer(b"".join(texts), dtype=self.dtype), np.concatenate([[0], np.cumsum(sizes)])


# --- cutting ------------------------------------------------------------------------------------------------

_GEAR = (np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(0xD1B54A32D192ED03)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)
_GEAR = _GEAR.astype(np.uint32)


def cut_marks(ids: np.ndarray) -> np.ndarray:
    """Where a chunk may end: the rolling hash of the last 8 ids has its upper CUT_BITS bits zero.

    h = sum of gear[id k places back] << 4k in 32 bits, so that ids 8 places back have left; built by doubling.
    """
    h = _GEAR[ids & 0xFFFF] + _GEAR[(ids >> 16) & 0xFFFF] * np.uint32(0x85EBCA6B) if ids.dtype.itemsize > 2 else _GEAR[ids].copy()
    for step, shift in ((1, 4), (2, 8), (4, 16)):
        moved = h[:-step] << np.uint32(shift)
        h[step:] = h[step:] + moved
    return np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1


def chunk_ends(marks: np.ndarray, size: int) -> list[int]:
    """Ends of the chunks of a stream of `size` ids, with marks relative to its start."""
    ends, at = [], 0
    for m in marks.tolist():
        while m - at > MOST:
            at += MOST
            ends.append(at)
        if m - at >= LEAST and m < size:
            at = m
            ends.append(at)
    while size - at > MOST:
        at += MOST
        ends.append(at)
    return [*ends, size] if size > at or not ends else ends


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of the binary tree over the leaves; leaves and inner nodes are hashed apart, an odd node moves up."""
    level = [digest(b"\x00" + x) for x in leaves] or [digest(b"\x02")]
    while len(level) > 1:
        level = [digest(b"\x01" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


# --- writing ------------------------------------------------------------------------------------------------

STORE_ROW = "kind int, part int, doc_id long, n int, key binary, body binary"
_ENCODERS: dict[str, SegmentEncoder] = {}


def _cut_batches(path: str, end: int, chunk_parts: int, bounds: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, SegmentEncoder(path))
        seen: set[bytes] = set()
        for batch in arrowtext.gathered(batches, SLICE_BYTES):
            for part in arrowtext.slices(batch, limit=SLICE_BYTES):
                ids, offsets = encoder.encode(arrowtext.texts(part), end)
                marks = cut_marks(ids)
                first = np.searchsorted(marks, offsets[:-1], side="right")
                last = np.searchsorted(marks, offsets[1:], side="right")
                doc_ids = part.column(0).to_pylist()
                kind, where, doc, n, key, body = [], [], [], [], [], []
                for i, doc_id in enumerate(doc_ids):
                    a, b = int(offsets[i]), int(offsets[i + 1])
                    recipe, at = [], a
                    for e in chunk_ends(marks[first[i] : last[i]] - a, b - a):
                        data = ids[at : a + e].tobytes()
                        name = digest(data)
                        recipe.append(name)
                        if name not in seen:
                            if len(seen) >= SEEN_CHUNKS:
                                seen.clear()
                            seen.add(name)
                            kind.append(0), where.append(int.from_bytes(name[:4], "little") % chunk_parts), doc.append(None)
                            n.append(a + e - at), key.append(name), body.append(data)
                        at = a + e
                    kind.append(1), where.append(chunk_parts + (0 if doc_id is None else int(np.searchsorted(bounds, doc_id, side="right")))), doc.append(doc_id)
                    n.append(b - a), key.append(merkle_root(recipe)), body.append(b"".join(recipe))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kind, pa.int32()), pa.array(where, pa.int32()), pa.array(doc, pa.int64()), pa.array(n, pa.int32()), pa.array(key, pa.binary()), pa.array(body, pa.binary())],
                    ["kind", "part", "doc_id", "n", "key", "body"],
                )

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal chunks of a part the first, wherever the others are; a task holds the digests of its part, about 100 bytes a chunk."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = batch.column(0).to_numpy() != 0
        if not keep.all():
            for i, (other, key) in enumerate(zip(keep.tolist(), batch.column(4).to_pylist())):
                if not other:
                    keep[i] = key not in seen
                    seen.add(key)
        yield batch.filter(pa.array(keep))


def write_store(docs: DataFrame, tokenizer_path: str, end: int, path: str) -> None:
    """Encode every whole text, append `end`, and write the store.

    One shuffle carries chunks to the part of their digest and recipes to the part of their doc_id range. A task
    sends a chunk it has seen only once, so that a chunk of a third of all documents reaches its part once a task.
    A null text is empty (its ids are the end id alone); a null doc_id sorts first; repeated rows each get a recipe,
    over the same chunks; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    clean = only(docs, doc_id="long", text="string")
    parts = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    recipes = max(1, parts // 4)
    # Range bounds from a scan of doc_id alone: one number a recipe part.
    bounds = clean.agg(F.percentile_approx("doc_id", [i / recipes for i in range(1, recipes)], 10_000)).collect()[0][0] if recipes > 1 else []
    cut = clean.mapInArrow(_cut_batches(tokenizer_path, end, parts, sorted(set(bounds or []))), STORE_ROW)
    ordered = cut.repartitionById(parts + recipes, F.col("part")).mapInArrow(_once, STORE_ROW)
    ordered.sortWithinPartitions("kind", F.when(F.col("kind") == 1, F.col("doc_id")), "key").write.option("compression", "zstd").partitionBy("kind").parquet(path)
    _write_manifest(spark, path)


def _roots(key, pdf):
    import pandas as pd

    pdf = pdf.sort_values(["doc_id", "name", "key"], na_position="first")
    ids = [None if pd.isna(x) else int(x) for x in (pdf["doc_id"].iloc[0], pdf["doc_id"].iloc[-1])]
    return pd.DataFrame([[int(key[0]), *ids, len(pdf), int(pdf["n"].sum()), merkle_root([f"{name}|{n}|".encode() + bytes(key) for name, n, key in zip(pdf["name"], pdf["n"], pdf["key"])])]], columns=["part", "first_doc", "last_doc", "n_docs", "n_tokens", "root"])


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a recipe part, from its recipes: the Merkle root over doc_id, length and root of each, and the ids before the part."""
    rows = _kind(spark, path, 1).select("part", "doc_id", "n", "key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"))
    roots = rows.groupBy("part").applyInPandas(_roots, "part int, first_doc long, last_doc long, n_docs long, n_tokens long, root binary")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part, a few hundred in all
    return roots.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def _write_manifest(spark: SparkSession, path: str) -> None:
    _manifest(spark, path).write.parquet(f"{path}/manifest")


def _held(spark: SparkSession, path: str) -> DataFrame:
    """part, part_start and held of every part: whether the manifest says what its recipes say. A part that is gone makes all false."""
    told = spark.read.parquet(f"{path}/manifest")
    made = _manifest(spark, path)
    same = [F.col(f"told.{c}").eqNullSafe(F.col(f"made.{c}")) for c in made.columns]
    both = told.alias("told").join(made.alias("made"), F.col("told.part") == F.col("made.part"), "full")
    whole = F.min(F.col("made.part").isNotNull()).over(Window.partitionBy())  # one row a part
    rows = both.select(F.col("made.part").alias("part"), F.coalesce("told.start", "made.start").alias("part_start"), (reduce(and_, same) & whole).alias("held"))
    return rows.where(F.col("part").isNotNull())


# --- reading ------------------------------------------------------------------------------------------------


def _kind(spark: SparkSession, path: str, kind: int) -> DataFrame:
    """Chunks or recipes. A store without any row of a kind has no such folder; it reads as empty."""
    schema = "part int, doc_id long, n int, key binary, body binary"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kind={kind}")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/kind={kind}")


def _checked(width: int):
    """Digest, length and crc32 (of the ids as 32 bits) of every stored chunk, from its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(0).to_pylist()
            ids = [np.frombuffer(b, dtype=f"<u{width}").astype("<u4") for b in bodies]
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(digest, bodies), pa.binary()), pa.array(map(len, ids), pa.int32()), pa.array([zlib.crc32(x) for x in ids], pa.int64())], ["digest", "n", "crc"]
            )

    return run


_POLY = np.uint64(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo the crc32 polynomial, bit-reflected, elementwise."""
    out, b = np.zeros_like(a), b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(bit)) & np.uint64(1), b, np.uint64(0))
        b = (b >> np.uint64(1)) ^ np.where(b & np.uint64(1), _POLY, np.uint64(0))
    return out


def crc_shifts(most: int) -> np.ndarray:
    """x to the power 32 n for n ids, n from 0 to most: what a crc is multiplied by when n ids follow it."""
    word = np.array([0x80000000], dtype=np.uint64)
    for _ in range(32):
        word = (word >> np.uint64(1)) ^ np.where(word & np.uint64(1), _POLY, np.uint64(0))
    out = np.array([0x80000000], dtype=np.uint64)
    power = word
    while len(out) <= most:  # out holds powers 0..k-1; append them times the k-th
        out = np.concatenate([out, _times(out, np.repeat(power, len(out)))])
        power = _times(power, power)
    return out[: most + 1]


def _joined_crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From each recipe's chunks in order: root, ids and crc of the document they make up."""
    shifts = crc_shifts(MOST)
    for batch in batches:
        roots, lists = batch.column(0).to_pylist(), batch.column(1)
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        flat = lists.flatten()
        row, seq = np.repeat(np.arange(len(roots)), np.diff(bounds)), flat.field("seq").to_numpy()
        order = np.lexsort((seq, row))
        n, each = flat.field("n").to_numpy()[order].astype(np.int64), flat.field("crc").to_numpy()[order].astype(np.uint64)
        digests = flat.field("digest").take(pa.array(order)).to_pylist()
        counts, crc = np.diff(bounds), np.zeros(len(roots), dtype=np.uint64)
        for k in range(int(counts.max(initial=0))):
            at = np.flatnonzero(counts > k)
            place = bounds[at] + k
            crc[at] = _times(crc[at], shifts[n[place]]) ^ each[place]
        total = np.bincount(row, n, len(roots)).astype(np.int64)
        same = [merkle_root(digests[a:b]) == r for r, a, b in zip(roots, bounds.tolist(), bounds[1:].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(roots, pa.binary()), pa.array(total), pa.array(crc.astype(np.int64)), pa.array(same)], ["root", "ids", "ids_crc32", "verified"])


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies = batch.column(1).to_pylist()
        counts = np.array([len(b) // DIGEST for b in bodies], dtype=np.int64)
        seq = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(np.repeat(np.arange(len(bodies)), counts))), pa.array(seq.astype(np.int32)), pa.array([b[i : i + DIGEST] for b in bodies for i in range(0, len(b), DIGEST)], pa.binary())],
            ["root", "seq", "digest"],
        )


def read_store(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """Every document of a store, from its files: doc_id, start, n_tokens, ids_crc32, n_chunks, root, verified.

    A chunk's digest, length and crc come from its stored bytes; a document's crc is put together from its chunks'
    in recipe order. Recipes with the same root are worked out once, whatever the number of their documents.
    `verified` is false where a recipe's root, length or part manifest doesn't follow from what was read; a wrong part
    manifest makes it false for the whole part.
    """
    recipes = _kind(spark, path, 1)
    stored = _kind(spark, path, 0).select("body").mapInArrow(_checked(width), "digest binary, n int, crc long")
    wanted = recipes.select(F.col("key").alias("root"), "body").dropDuplicates(["root"]).mapInArrow(_references, "root binary, seq int, digest binary")
    found = wanted.join(stored, "digest").groupBy("root").agg(F.collect_list(F.struct("seq", "digest", "n", "crc")).alias("chunks"))
    made = found.mapInArrow(_joined_crcs, "root binary, ids long, ids_crc32 long, verified boolean")
    manifest = _held(spark, path)
    before = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = recipes.select("part", "doc_id", "n", "key", (F.length("body") / DIGEST).cast("long").alias("n_chunks")).withColumn("inner", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return (
        placed.join(manifest, "part")
        .join(made.withColumnRenamed("root", "key"), "key", "left")
        .select(
            "doc_id",
            (F.col("part_start") + F.col("inner")).cast("long").alias("start"),
            F.col("n").cast("long").alias("n_tokens"),
            "ids_crc32",
            "n_chunks",
            F.lower(F.hex("key")).alias("root"),
            F.coalesce(F.col("verified") & (F.col("ids") == F.col("n")) & F.col("held"), F.lit(False)).alias("verified"),
        )
    )


def read_documents(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id and the whole id stream of every document, put together from recipes and chunks."""
    recipes = _kind(spark, path, 1).withColumn("row", F.monotonically_increasing_id())
    refs = recipes.select(F.col("doc_id"), "row", F.explode(F.expr(f"transform(sequence(0, cast(length(body) / {DIGEST} as int) - 1), i -> struct(i as seq, substring(body, i * {DIGEST} + 1, {DIGEST}) as key))")).alias("r"))
    chunks = _kind(spark, path, 0).select("key", F.col("body").alias("ids"))
    lists = refs.select("doc_id", "row", "r.seq", "r.key").join(chunks, "key").groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "ids"))).alias("chunks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(c["ids"] for c in x), dtype=f"<u{width}").astype(np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return lists.select("doc_id", "chunks").mapInArrow(run, "doc_id long, ids array<long>")


def token_store(docs: DataFrame, tokenizer_path: str, end: int = 1, path: str | None = None) -> DataFrame:
    """Write the store (in the shared folder, or at `path`) and read every document back from its files."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-store")
    write_store(docs, tokenizer_path, end, path)
    return read_store(spark, path, SegmentEncoder(tokenizer_path).dtype.itemsize)
