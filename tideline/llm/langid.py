"""Language identification, word first.

A word known to the model counts by its log frequency in each language. An unseen word is scored by its character
n-grams: at every place the longest n-gram the model knows, falling back to shorter ones at a price a step.

Words and n-grams are known by 64-bit hashes of their letters (two of a million units share one with a chance of about
one in 30 million). The model is one sorted array of hashes with a sparse row of languages each; whole batches of
distinct words are hashed and looked up at once, so a worker holds the model and one slice of text, and no cache.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import arrowtext
from .common import fresh, only, small_batches

LONGEST = 5
UNKNOWN = "und"
LONGEST_WORD = 60  # letters of a run taken as one word; a longer run counts as several, none of it is left out
SLICE_BYTES = 4_000_000
PARTS_AT_ONCE = 40_000
WORD = 0  # the kind of a unit: a word, or the length of an n-gram
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_LETTER: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTER:
        table = np.zeros(0x110000, dtype=bool)
        for m in regex.finditer(r"\p{L}+", "".join(map(chr, range(0x110000)))):
            table[m.start() : m.end()] = True
        _LETTER.append(table)
    return _LETTER[0]


def _fold(h: np.ndarray, letters: np.ndarray) -> np.ndarray:
    h = (h ^ letters) * _A
    h ^= h >> np.uint64(29)
    h *= _B
    return h ^ (h >> np.uint64(32))


@dataclass
class Parts:
    """The letter runs of an array of words: letters between '^' and '$', begin and length of each, and its word."""

    letters: np.ndarray
    begin: np.ndarray  # of '^'
    length: np.ndarray  # without the two marks
    word: np.ndarray

    def __len__(self) -> int:
        return len(self.begin)

    def hashes(self) -> np.ndarray:
        """One hash a part, of the letters without the marks."""
        h = np.full(len(self), 0x5851F42D4C957F2D, np.uint64)
        live, k = np.arange(len(self)), 0
        while len(live):
            h[live] = _fold(h[live], self.letters[self.begin[live] + 1 + k])
            k += 1
            live = live[self.length[live] > k]
        return h

    def some(self, chosen: np.ndarray) -> Parts:
        size = self.length[chosen] + 2
        return Parts(arrowtext.ragged(self.letters, self.begin[chosen], size), np.cumsum(size) - size, self.length[chosen], self.word[chosen])

    def grams(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """For every place its part and the letters to the part's end; for n = 1.. LONGEST the hash of the n-gram there."""
        size = self.length + 2
        part = np.repeat(np.arange(len(self)), size)
        room = np.repeat(self.begin + size, size) - np.arange(len(self.letters))
        h, out = np.zeros(len(self.letters), np.uint64), []
        for n in range(1, LONGEST + 1):
            h = _fold(h[: len(self.letters) - n + 1], self.letters[n - 1 :])
            out.append(h)
        return part, room, out


def parts_of(distinct: pa.Array) -> Parts:
    """The parts of lower-cased words, runs beyond LONGEST_WORD cut."""
    distinct = distinct.cast(pa.large_string())
    word_length = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
    data = distinct.buffers()[2]
    flat = data[int(offsets[0]) : int(offsets[-1])].to_pybytes() if data is not None and len(distinct) else b""
    points = np.frombuffer(flat.decode().encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.repeat(np.arange(len(distinct)), word_length)
    real = letter_table()[points]
    joined = real[1:] & real[:-1] & (word[1:] == word[:-1])  # letter i + 1 goes on with letter i's run
    start = np.flatnonzero(real & ~np.concatenate([[False], joined])) if len(points) else np.zeros(0, np.int64)
    end = np.flatnonzero(real & ~np.concatenate([joined, [False]])) + 1 if len(points) else np.zeros(0, np.int64)
    pieces = -(-(end - start) // LONGEST_WORD)
    run = np.repeat(np.arange(len(start)), pieces)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    a = start[run] + nth * LONGEST_WORD
    length = np.minimum(end[run] - a, LONGEST_WORD)
    begin = np.cumsum(length + 2) - (length + 2)
    letters = np.empty(int((length + 2).sum()), np.uint64)
    inner = np.ones(len(letters), dtype=bool)
    inner[begin] = inner[begin + length + 1] = False
    letters[begin], letters[begin + length + 1] = ord("^"), ord("$")
    letters[inner] = arrowtext.ragged(points, a, length)
    return Parts(letters, begin, length, word[a] if len(a) else a)


@dataclass
class Model:
    """Log frequencies by language of words and of n-grams: `units` sorted, unit i in languages lang[begin[i]:begin[i + 1]]."""

    langs: list[str]
    units: np.ndarray  # uint64
    begin: np.ndarray
    lang: np.ndarray  # int32
    gain: np.ndarray  # float32, log frequency above that of a unit the language doesn't have
    absent: np.ndarray  # kind x language, log frequency of a unit the language doesn't have
    step: float = math.log(0.4)  # for each letter by which a known n-gram is shorter than LONGEST
    floor: float = math.log(1e-6)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes among the units, -1 where unknown."""
        if not len(self.units):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.units, h), len(self.units) - 1)
        return np.where(self.units[at] == h, at, -1)

    def _gains(self, owner: np.ndarray, unit: np.ndarray, owners: int) -> np.ndarray:
        """Sums over units of their sparse rows: owners x languages."""
        k, count = len(self.langs), self.begin[unit + 1] - self.begin[unit]
        cell = np.repeat(owner, count) * k + arrowtext.ragged(self.lang, self.begin[unit], count)
        return np.bincount(cell, arrowtext.ragged(self.gain, self.begin[unit], count), owners * k).reshape(owners, k)

    def scores(self, parts: Parts) -> np.ndarray:
        """Log scores of every part by language."""
        out = np.empty((len(parts), len(self.langs)))
        unit = self._find(parts.hashes())
        known = np.flatnonzero(unit >= 0)
        out[known] = self.absent[WORD] + self._gains(np.arange(len(known)), unit[known], len(known))
        unseen = np.flatnonzero(unit < 0)
        for i in range(0, len(unseen), PARTS_AT_ONCE):
            chosen = unseen[i : i + PARTS_AT_ONCE]
            out[chosen] = self._backoff(parts.some(chosen))
        return out

    def _backoff(self, parts: Parts) -> np.ndarray:
        """Mean over the places of a part of the longest known n-gram's log frequency, less the price of its steps."""
        part, room, hashes = parts.grams()
        places, total = np.arange(len(part)), np.zeros((len(parts), len(self.langs)))
        for n in range(LONGEST, 0, -1):
            fits = places[room[places] >= n]
            unit = self._find(hashes[n - 1][fits])
            hit = unit >= 0
            owner = part[fits[hit]]
            total += self._gains(owner, unit[hit], len(parts))
            total += np.bincount(owner, minlength=len(parts))[:, None] * (self.absent[n] + self.step * (LONGEST - n))
            places = np.setdiff1d(places, fits[hit], assume_unique=True)
        total += np.bincount(part[places], minlength=len(parts))[:, None] * self.floor
        return total / (parts.length + 2)[:, None]

    def predict(self, values: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and its share of belief, 0 to 1, of every text; UNKNOWN and 0 where no letter is."""
        k, n = len(self.langs), len(values)
        if not k:
            return [UNKNOWN] * n, np.zeros(n)
        distinct, codes, offsets = arrowtext.words(pc.utf8_lower(values))
        parts = parts_of(distinct)
        scores = self.scores(parts)
        lettered = np.bincount(parts.word, minlength=len(distinct)) > 0
        count = arrowtext.sums(lettered[codes].astype(np.int64), offsets)
        totals, full = np.zeros((n, k)), np.flatnonzero(offsets[1:] > offsets[:-1])
        if len(full):
            for c in range(k):
                column = np.bincount(parts.word, scores[:, c], len(distinct))
                totals[full, c] = np.add.reduceat(column[codes], offsets[full])
        best = totals.argmax(axis=1)  # ties to the first language of the alphabet
        share = 1.0 / np.exp(totals - totals.max(axis=1)[:, None]).sum(axis=1)
        told = [self.langs[b] if c else UNKNOWN for b, c in zip(best.tolist(), count.tolist())]
        return told, np.round(np.where(count > 0, share, 0.0), 6)

    def slice_bytes(self) -> int:
        """Text at a time, so that the table of distinct words by languages stays as small as with eight languages."""
        return SLICE_BYTES * 8 // max(8, len(self.langs))


# --- training -----------------------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0. A null id is not held out, nor trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def unit_counts(values: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Occurrences in texts: for each kind the distinct hashes and how often each occurs."""
    distinct, codes, _ = arrowtext.words(pc.utf8_lower(values))
    parts, often = parts_of(distinct), np.bincount(codes, minlength=len(distinct))
    n = often[parts.word]
    part, room, grams = parts.grams()
    for kind in range(LONGEST + 1):
        if kind == WORD:
            h, weight = parts.hashes(), n
        else:
            fits = np.flatnonzero(room >= kind)
            h, weight = grams[kind - 1][fits], n[part[fits]]
        units, at = np.unique(h, return_inverse=True)
        yield kind, units, np.bincount(at, weight, len(units)).astype(np.int64)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in arrowtext.slices(batch, limit=SLICE_BYTES):
            langs = np.array(part.column(0).to_pylist())
            values = arrowtext.texts(part)
            for lang in sorted(set(langs.tolist())):
                for kind, units, n in unit_counts(values.filter(pa.array(langs == lang))):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(units), pa.string()), pa.array(np.full(len(units), kind, np.int32)), pa.array(units.view(np.int64)), pa.array(n)], ["lang", "kind", "unit", "n"]
                    )


def train(docs: DataFrame, sample_docs: int = 1000, least_seen: int = 3) -> Model:
    """Fit on a bounded sample of the documents outside the held-out fold that have a lang.

    The sample is, of every language, the `sample_docs` documents of smallest hash of their id, so that no language is
    too rare to be learned. All words and n-grams of the sample are in the model, but for words that it holds fewer
    than `least_seen` times: their n-grams say more. What reaches the driver is the table of these units: its size
    depends on the sample alone. Documents with null text, lang or id are not trained on. With no document to learn
    from, the model knows no language.
    """
    small_batches(docs.sparkSession)
    order = F.xxhash64("doc_id")
    usable = only(docs, doc_id="long", text="string", lang="string").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("h", order)
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    # One row a language, as the model itself has one column a language.
    last = usable.select("lang", "h").withColumn("rank", first).where(F.col("rank") <= sample_docs).groupBy("lang").agg(F.max("h").alias("last"))
    sample = usable.join(F.broadcast(last), "lang").where((F.col("h") <= F.col("last")) & F.col("text").isNotNull())
    counts = sample.select("lang", "text").mapInArrow(_count_batches, "lang string, kind int, unit long, n long").groupBy("lang", "kind", "unit").agg(F.sum("n").alias("n"))
    return fitted(counts.toArrow(), least_seen)


def fitted(counts: pa.Table, least_seen: int) -> Model:
    """The model of counts by lang, kind and unit."""
    coded = counts.column("lang").combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    names = coded.dictionary.to_pylist()
    langs = sorted(names)
    lang = np.array([langs.index(x) for x in names], np.int64)[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)] if names else np.zeros(0, np.int64)
    kind, unit, n = (counts.column(c).to_numpy() for c in ("kind", "unit", "n"))
    unit = unit.view(np.uint64) if unit.dtype == np.int64 else unit.astype(np.uint64)
    total = np.bincount(kind * len(langs) + lang, n, (LONGEST + 1) * len(langs)).reshape(LONGEST + 1, len(langs))
    order = np.lexsort((lang, unit))
    lang, kind, unit, n = lang[order], kind[order], unit[order], n[order]
    units, begin, size = np.unique(unit, return_index=True, return_counts=True)
    seen = np.add.reduceat(n, begin) if len(n) else n
    keep = (kind[begin] != WORD) | (seen >= least_seen) if len(n) else np.zeros(0, bool)
    entries = np.repeat(keep, size)
    size = size[keep]
    gain = np.log((n[entries] + 0.1) / 0.1).astype(np.float32)
    return Model(langs, units[keep], np.concatenate([[0], np.cumsum(size)]).astype(np.int64), lang[entries].astype(np.int32), gain, np.log(0.1 / (total + 1000)))


# --- prediction ---------------------------------------------------------------------------------------------


def _predict_batches(shared, text_at: int, kept: int, names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            name = batch.schema.names[text_at]
            for part in arrowtext.slices(batch, name, model.slice_bytes()):
                lang, share = model.predict(arrowtext.texts(part, name))
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], pa.array(lang, pa.string()), pa.array(share)], [*part.schema.names[:kept], *names])

    return run


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """lang_pred and score (under `names`) of every row's whole text, beside the columns `keep`; no shuffle.

    Text alone enters a prediction. A null text, or one without a letter, is 'und' with score 0; repeated rows are
    each predicted; columns not in `keep` are ignored whatever their names; `names` must not be among `keep`. A text
    column that is kept is sent once. The model is broadcast: its size is bounded by the training sample.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    sent_once = "text" in keep and dict(docs.dtypes)["text"] == "string"
    chosen = docs.select(*keep) if sent_once else docs.select(*keep, F.col("text").cast("string").alias(fresh(keep, "text")))
    text_at = list(keep).index("text") if sent_once else len(keep)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.schema.fields[: len(keep)])
    return chosen.mapInArrow(arrowtext.trimmed(_predict_batches(shared, text_at, len(keep), names)), f"{schema}`{names[0]}` string, `{names[1]}` double")
