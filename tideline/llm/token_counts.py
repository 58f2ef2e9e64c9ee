"""Token counts of byte-level BPE by rank-synchronous array merging.

Pre-tokens of a batch are held as one ragged array of symbol ids. In each round every
sequence finds its pair of lowest rank and merges it wherever it stands; sequences that
have no pair left drop out, and what survives is counted. Nothing is tokenized one word
at a time, and a segment seen before is not merged again.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from . import arrowtext
from .common import only, small_batches

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STOPS = tuple(".,;:!?|)")
NONE = np.uint32(0xFFFFFFFF)
CACHE_ENTRIES = 300_000
PIECES_AT_ONCE = 100_000


def byte_letters() -> list[str]:
    """The printable letter by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(extra)
            extra += 1
    return [letters[b] for b in range(256)]


class PairRanks:
    """Merge ranks in an open-addressing hash table that whole arrays of pairs probe at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        size = 1 << max(4, int(len(left) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - size.bit_length() + 1), size - 1
        self.keys = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.ranks = np.full(size, NONE)
        self.merged = merged.astype(np.int32)
        for rank, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
            key = (a << 32) | b
            slot = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
            while self.keys[slot] != 0xFFFFFFFFFFFFFFFF and self.keys[slot] != key:
                slot = (slot + 1) & self.mask
            if self.keys[slot] != key:
                self.keys[slot], self.ranks[slot] = key, rank

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        slot = ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        at = self.keys[slot]
        out = np.where(at == key, self.ranks[slot], NONE)
        open_ = np.flatnonzero((at != key) & (at != np.uint64(0xFFFFFFFFFFFFFFFF)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            at = self.keys[slot[open_]]
            hit = at == key[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (at != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return out


class ByteBpe:
    """Vocabulary, merges and special strings of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        cut = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True)) != ("ByteLevel", False, True) or spec["model"].get("ignore_merges"):
            raise ValueError(f"{path}: not a byte-level file cut by the usual pattern and merged by rank alone")
        vocab = spec["model"]["vocab"]
        self.byte_ids = np.array([vocab[x] for x in byte_letters()], dtype=np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        column = lambda f: np.array([f(p) for p in pairs], dtype=np.int64)
        self.pairs = PairRanks(column(lambda p: vocab[p[0]]), column(lambda p: vocab[p[1]]), column(lambda p: vocab[p[0] + p[1]]))
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.pieces: dict[str, int] = {}
        self.spaced: dict[str, int] = {}

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text in order, and how many special strings stand between them."""
        if self.special_pattern is None or not any(x in text for x in self.special):
            return self.pattern.findall(text), 0
        parts = self.special_pattern.split(text)
        return [p for part in parts[::2] for p in self.pattern.findall(part)], len(parts) // 2

    def merge_counts(self, pieces: list[str]) -> np.ndarray:
        """How many symbols of each piece survive when every merge has been applied."""
        raw = [p.encode() for p in pieces]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        counts = np.zeros(len(raw), dtype=np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(raw)), length)
        inner = np.zeros(len(symbols), dtype=bool)  # a pair starts here
        inner[:-1] = owner[:-1] == owner[1:]
        ranks = np.full(len(symbols), NONE)
        at = np.flatnonzero(inner)
        ranks[at] = self.pairs.find(symbols[at], symbols[at + 1])
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            size = np.diff(np.append(first, len(symbols)))
            least = np.minimum.reduceat(ranks, first)
            done = least == NONE
            if done.any():
                counts[owner[first[done]]] = size[done]
                live = np.repeat(~done, size)
                symbols, owner, ranks = symbols[live], owner[live], ranks[live]
                size, least = size[~done], least[~done]
                if not len(symbols):
                    break
            chosen = ranks == np.repeat(least, size)
            at = np.flatnonzero(chosen)
            same = symbols[at] == symbols[at + 1]
            if same.any():  # in a run of equal symbols every other pair merges, from the left
                run = np.concatenate([[0], np.cumsum((np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]]))])
                head = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
                at = at[(np.arange(len(at)) - head[run]) % 2 == 0]
            symbols[at] = self.pairs.merged[ranks[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            shift = np.cumsum(keep) - 1
            symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
            at = shift[at]
            touched = np.concatenate([at, at[at > 0] - 1])
            ranks[touched] = NONE
            pair = touched[touched + 1 < len(symbols)]
            pair = pair[owner[pair] == owner[pair + 1]]
            ranks[pair] = self.pairs.find(symbols[pair], symbols[pair + 1])
        return counts

    def learn(self, pieces: Iterable[str]) -> None:
        """Count the pieces that are not known yet, in blocks of bounded size."""
        new = [p for p in dict.fromkeys(pieces) if p not in self.pieces]
        start, size = 0, 0
        for i, p in enumerate(new):
            size += len(p)
            if i + 1 == len(new) or i + 1 - start >= PIECES_AT_ONCE or size > 8_000_000:
                block = new[start : i + 1]
                self.pieces.update(zip(block, self.merge_counts(block).tolist()))
                start, size = i + 1, 0

    def count(self, text: str) -> int:
        """Tokens of one text, pre-tokenized as a whole."""
        pieces, special = self.pretokens(text)
        self.learn(pieces)
        return special + sum(map(self.pieces.__getitem__, pieces))

    def _segment_values(self, found: list[str]) -> np.ndarray:
        """For ' ' + segment: its tokens * 4 + 2 if it ends in white space + 1 if white space or a special string starts it."""
        new = [s for s in found if s not in self.spaced]
        plain = [s for s in new if s.isalpha()]
        ended = [s for s in new if s[-1:] in STOPS and s[:-1].isalpha()]
        known = {*plain, *ended}
        other = [(s, *self.pretokens(" " + s)) for s in new if s not in known]
        heads = [" " + s for s in plain] + [" " + s[:-1] for s in ended]
        self.learn(chain(heads, STOPS, (p for _, pieces, _ in other for p in pieces)))
        count = self.pieces.__getitem__
        self.spaced.update(zip(plain, [4 * n for n in map(count, heads)]))
        self.spaced.update(zip(ended, [4 * (n + count(s[-1])) for n, s in zip(map(count, heads[len(plain) :]), ended)]))
        for s, pieces, special in other:
            n = special + sum(map(count, pieces))
            self.spaced[s] = n * 4 + 2 * (not s or s[-1].isspace()) + (not s or s[0].isspace() or any(map(s.startswith, self.special)))
        return np.fromiter(map(self.spaced.__getitem__, found), np.int64, len(found))

    def counts(self, values: pa.Array) -> np.ndarray:
        """Tokens of every text.

        A text is cut before each space whose neighbours are not both white space: the pre-token
        pattern has a boundary there whatever stands around. Texts with other spaces are taken whole.
        """
        if len(self.pieces) > CACHE_ENTRIES:
            self.pieces.clear()
        if len(self.spaced) > CACHE_ENTRIES:
            self.spaced.clear()
        distinct, codes, offsets = arrowtext.segments(values)
        value = self._segment_values(distinct.to_pylist())[codes]
        heads = offsets[:-1]
        number, ends, starts = value >> 2, (value & 2) > 0, (value & 1) > 0
        first = distinct.take(pa.array(codes[heads])).to_pylist()  # before the first space of a text none stands in front
        split = list(map(self.pretokens, first))
        self.learn(p for pieces, _ in split for p in pieces)
        number[heads] = [special + sum(map(self.pieces.__getitem__, pieces)) for pieces, special in split]
        ends[heads] = [not x or x[-1].isspace() for x in first]
        whole = np.zeros(len(value), dtype=bool)
        whole[1:] = ends[:-1] & starts[1:]
        whole[heads] = False
        out = arrowtext.sums(number, offsets)
        for i in np.flatnonzero(arrowtext.sums(whole.astype(np.int64), offsets)):
            out[i] = self.count(values[int(i)].as_py())
        return out


_LOADED: dict[str, ByteBpe] = {}


def _count_batches(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _LOADED.get(path) or _LOADED.setdefault(path, ByteBpe(path))
        for batch in batches:
            for part in arrowtext.slices(batch):
                values = arrowtext.texts(part)
                n = bpe.counts(values)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pc.binary_length(values).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """Tokens of each document's whole text under a byte-level BPE file; one row per input row, no shuffle.

    A null text counts as empty (0 bytes, 0 tokens); a null doc_id stays null; repeated rows are each
    counted; other columns are ignored whatever their names. Special strings inside a text count as one
    token each, as the tokenizers library does by default. Texts of any length are counted whole.
    """
    small_batches(docs.sparkSession)
    return only(docs, doc_id="long", text="string").mapInArrow(
        _count_batches(tokenizer_path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
