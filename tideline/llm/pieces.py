"""N-best segmentation over a piece lattice: forward Viterbi scores as exact heuristics of a backward A* search.

A lattice has a node between any two letters of a normalized text and an edge for each vocabulary piece that fits;
a path's score is the sum of its pieces' log-probabilities. Those of a unigram file are its scores. A merge file's
scores are minus ranks in the order of merging, whose sums mean nothing: a piece of rank r takes -log(r + RANK_SHIFT)
- PIECE_COST, the log-frequency that falls with rank by Zipf's law and a cost that favours long pieces as merging does.
Nothing is fitted. The forward pass gives each node the best score
of reaching it, which is exactly what a path found from the end can still gain: A* takes complete paths in order
of their scores, and expands nothing that a better path doesn't need.

No piece reaches over a word's beginning, so a text's lattice is a chain of its words' lattices. Words are solved
once each and many at a time; the best paths of a text are then put together from those of its words.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor

from . import arrowtext
from .common import only, small_batches

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHE_ENTRIES, WAYS = 80_000, 60_000
RANK_SHIFT, PIECE_COST = 2.7, 10.0
UNIGRAM, MERGES = 1, 2
LETTERS_AT_ONCE = 200_000
IDS_AT_ONCE = 500_000  # in a batch that goes back, over all paths of its texts
RUNS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    """Fields of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            byte = data[i]
            i += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while i < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            size = varint()
            yield key >> 3, data[i : i + size]
            i += size
        else:
            size = 4 if key & 7 == 5 else 8
            yield key >> 3, struct.unpack("<f" if size == 4 else "<d", data[i : i + size])[0]
            i += size


class Solved(tuple):
    """ids as bytes, pieces, best score, loss of the second best (inf if there is none), whether decoding gives the word back."""


class PieceModel:
    """Pieces and scores of a SentencePiece model file whose normalization is the identity with a leading mark."""

    def __init__(self, path: str | None = None, pieces: list[tuple[str, float, int]] | None = None, kind: int = UNIGRAM):
        if pieces is None:
            pieces = []
            with open(path, "rb") as file:
                for number, value in _fields(file.read()):
                    if number == 1:
                        f = dict(_fields(value))
                        pieces.append((f[1].decode(), float(f.get(2, 0.0)), f.get(3, NORMAL)))
                    elif number == 2:
                        kind = dict(_fields(value)).get(3, UNIGRAM)
        if kind == MERGES:
            pieces = [(p, -math.log(RANK_SHIFT - s) - PIECE_COST if k in (NORMAL, USER) else s, k) for p, s, k in pieces]
        if any(MARK in p.lstrip(MARK) for p, _, k in pieces if k in (NORMAL, USER)):
            raise ValueError("a piece reaches over the beginning of a word: words can't be solved apart")
        self.kind = kind
        self.pieces = pieces
        self.scores = {p: (s, i) for i, (p, s, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.spelled = [p for p, _, _ in pieces]
        self.control = {i for i, (_, _, kind) in enumerate(pieces) if kind in (CONTROL, UNKNOWN)}
        self.unknown_id = next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
        self.unknown_score = min((s for s, _ in self.scores.values()), default=0.0) - 10
        self.longest = max(map(len, self.scores), default=1)
        self.solved = arrowtext.Recent(CACHE_ENTRIES)
        self.ways: dict[tuple[str, int], tuple[list[float], list[bytes]]] = {}
        self._trie()

    # --- the lattice of one word, plainly ---

    def edges(self, word: str) -> list[list[tuple[int, float, int]]]:
        """For each node the edges into it: (start, score, piece or -1), longest piece first."""
        into: list[list[tuple[int, float, int]]] = [[] for _ in range(len(word) + 1)]
        for a in range(len(word)):
            single = False
            for b in range(a + 1, min(len(word), a + self.longest) + 1):
                found = self.scores.get(word[a:b])
                if found is not None:
                    into[b].append((a, *found))
                    single |= b == a + 1
            if not single:
                into[a + 1].append((a, self.unknown_score, -1))
        return [sorted(e) for e in into]

    def nbest(self, word: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best paths of a word as (score, pieces, -1 an unknown letter); ties to the longer last pieces."""
        if not word:
            return [(0.0, [])]
        into = self.edges(word)
        forward = [0.0] + [-math.inf] * len(word)
        for b in range(1, len(word) + 1):
            forward[b] = max(forward[a] + s for a, s, _ in into[b])
        # A hypothesis covers the text from `node` to the end; forward[node] is exactly what it can still gain.
        queue = [(-forward[-1], (), len(word), 0.0, ())]
        out = []
        while queue and len(out) < n:
            _, starts, node, gained, path = heapq.heappop(queue)
            if node == 0:
                out.append((gained, list(path[::-1])))
                continue
            for a, s, piece in into[node]:
                heapq.heappush(queue, (-(gained + s + forward[a]), (*starts, a), a, gained + s, (*path, piece)))
        return out

    # --- the best paths of many words at once ---

    def _trie(self) -> None:
        children: dict[int, int] = {}
        ends: list[tuple[float, int]] = [(-math.inf, -1)]
        for piece, (score, number) in self.scores.items():
            state = 0
            for letter in map(ord, piece):
                key = (state << 21) | letter
                if key not in children:
                    children[key] = len(ends)
                    ends.append((-math.inf, -1))
                state = children[key]
            ends[state] = (score, number)
        self.end_score, self.end_piece = np.array([s for s, _ in ends]), np.array([p for _, p in ends], dtype=np.int32)
        size = 1 << max(4, (len(children) * 4).bit_length())
        self.slots = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.next = np.zeros(size, dtype=np.int32)
        self.shift = np.uint64(65 - size.bit_length())
        for key, child in children.items():
            slot = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
            while self.slots[slot] != 0xFFFFFFFFFFFFFFFF:
                slot = (slot + 1) & (size - 1)
            self.slots[slot], self.next[slot] = key, child

    def _step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The trie's child states, 0 where there is none."""
        key = (states.astype(np.uint64) << np.uint64(21)) | letters
        slot = ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        at = self.slots[slot]
        out = np.where(at == key, self.next[slot], 0)
        todo = np.flatnonzero((at != key) & (at != np.uint64(0xFFFFFFFFFFFFFFFF)))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)
            at = self.slots[slot[todo]]
            hit = at == key[todo]
            out[todo[hit]] = self.next[slot[todo[hit]]]
            todo = todo[~hit & (at != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return out

    def solve(self, words: list[str]) -> None:
        """Best path, second-best loss and round trip of each word that is not known yet."""
        new = self.solved.recall(list(dict.fromkeys(words)))
        start, size = 0, 0
        for i, w in enumerate(new):
            size += len(w)
            if i + 1 == len(new) or size >= LETTERS_AT_ONCE:
                self._solve(new[start : i + 1])
                start, size = i + 1, 0

    def _solve(self, words: list[str]) -> None:
        length = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        last = np.repeat(np.cumsum(length), length)  # the end of the word each letter is in
        # Node numbers: word w has length + 1 of them, letter i of it leads from node i to i + 1.
        node = np.arange(len(letters)) + np.repeat(np.arange(len(words)), length)
        first_node = np.cumsum(length + 1) - (length + 1)
        here = np.arange(len(letters))
        states = np.zeros(len(letters), dtype=np.int64)
        known = np.zeros(len(letters), dtype=bool)
        found = []
        for k in range(1, self.longest + 1):
            inside = here + k - 1 < last[here]
            here, states = here[inside], states[inside]
            states = self._step(states, letters[here + k - 1])
            alive = states > 0
            here, states = here[alive], states[alive]
            if not len(here):
                break
            piece = self.end_piece[states]
            full = piece >= 0
            if k == 1:
                known[here[full]] = True
            found.append((node[here[full]], node[here[full]] + k, self.end_score[states[full]], piece[full]))
        lost = np.flatnonzero(~known)
        found.append((node[lost], node[lost] + 1, np.full(len(lost), self.unknown_score), np.full(len(lost), -1, dtype=np.int32)))
        start, end, score, piece = (np.concatenate(c) for c in zip(*found))
        place = np.arange(int((length + 1).sum())) - np.repeat(first_node, length + 1)  # of a node within its word
        order = np.lexsort((start, end, place[end]))
        start, end, score, piece = start[order], end[order], score[order], piece[order]
        forward = np.zeros(len(place))
        came = np.zeros(len(place), dtype=np.int64)  # the edge by which the best path enters a node
        spare = np.full(len(place), np.inf)  # what the second best edge into a node loses
        bounds = np.searchsorted(place[end], np.arange(1, int(length.max(initial=0)) + 2))
        for a, b in zip(bounds[:-1], bounds[1:]):
            value = forward[start[a:b]] + score[a:b]
            head = np.flatnonzero(np.concatenate([[True], end[a + 1 : b] != end[a : b - 1]]))
            count = np.diff(np.append(head, b - a))
            best = np.maximum.reduceat(value, head)
            wins = np.flatnonzero(value == np.repeat(best, count))
            group = np.repeat(np.arange(len(head)), count)
            winner = wins[np.unique(group[wins], return_index=True)[1]]  # of equal ones the earliest start, the longest piece
            target = end[a + head]
            forward[target], came[target] = best, a + winner
            value[winner] = -np.inf
            spare[target] = best - np.maximum.reduceat(value, head)
        # Back along all best paths together.
        at = first_node + length
        loss = np.full(len(words), np.inf)
        live = np.flatnonzero(length > 0)
        steps = []
        while len(live):
            loss[live] = np.minimum(loss[live], spare[at[live]])
            edge = came[at[live]]
            steps.append((live, piece[edge], at[live]))
            at[live] = start[edge]
            live = live[at[live] > first_node[live]]
        paths: list[list[int]] = [[] for _ in words]
        for who, pieces, nodes in reversed(steps):
            for w, p, e in zip(who.tolist(), pieces.tolist(), (nodes - first_node[who]).tolist()):
                paths[w].append(p if p >= 0 else -e)
        totals, losses, spelled = forward[first_node + length].tolist(), loss.tolist(), self.spelled
        for word, path, total, least in zip(words, paths, totals, losses):
            if min(path) >= 0:
                same = "".join([spelled[p] for p in path]) == word
            else:  # -e stands for the letter before node e
                path = [i for p in path for i in ([p] if p >= 0 else self.fallback(word[-p - 1]))]
                same = self.join(path) == word
            self.solved[word] = Solved((array("I", path).tobytes(), len(path), total, least, same))

    def fallback(self, letter: str) -> list[int]:
        """Byte pieces of a letter no piece covers, or the unknown piece where the model has none."""
        return [self.bytes[b] for b in letter.encode()] if self.bytes else [self.unknown_id]

    def join(self, ids: list[int]) -> str:
        """The normalized text of ids; bytes that are no UTF-8 give the replacement character."""
        out = bytearray()
        for i in ids:
            if i in self.byte_of:
                out.append(self.byte_of[i])
            elif i not in self.control:
                out += self.pieces[i][0].encode()
        return out.decode("utf-8", "replace")

    # --- texts ---

    @staticmethod
    def words(text: str) -> list[str]:
        """The words of a text's lattice: cut wherever a letter is followed by the mark."""
        return RUNS.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        words = self.words(text)
        self.solve(words)
        return np.frombuffer(b"".join(self.solved[w][0] for w in words), dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        text = self.join(ids).replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text

    def spell(self, word: str, path: list[int]) -> bytes:
        """Ids of a path of `nbest`, an unknown letter by its fallback."""
        out, at = array("I"), 0
        for p in path:
            out.extend([p] if p >= 0 else self.fallback(word[at]))
            at += len(self.spelled[p]) if p >= 0 else 1
        return out.tobytes()

    def word_paths(self, word: str, n: int) -> tuple[list[float], list[bytes]]:
        """What the n best paths of a word lose against the best, and their ids, by A*."""
        found = self.ways.get((word, n))
        if found is None:
            if len(self.ways) > WAYS:
                self.ways.clear()
            paths = self.nbest(word, n)
            found = self.ways[word, n] = [paths[0][0] - s for s, _ in paths], [self.spell(word, p) for _, p in paths]
        return found

    def text_paths(self, words: list[str], n: int) -> tuple[list[float], list[dict[int, bytes]]]:
        """The losses of a text's n best paths, and the ids of the words that leave their best path, by place among `words`.

        A* over the chain of words each with its own paths, whose remaining loss is 0. Of m words only the n - 1 with the
        smallest second-best losses can leave their best path in any of the n.
        """
        ways = [(i, *self.word_paths(w, n)) for i, w in enumerate(words)]
        ways = [x for x in ways if len(x[1]) > 1]
        queue, losses, changes = [(0.0, (0,) * len(ways), 0)], [], []
        while queue and len(losses) < n:
            loss, ranks, least = heapq.heappop(queue)
            losses.append(loss)
            changes.append({ways[k][0]: ways[k][2][r] for k, r in enumerate(ranks) if r})
            for i in range(least, len(ways)):  # each choice of ranks is reached in one way
                own = ways[i][1]
                if ranks[i] + 1 < len(own):
                    heapq.heappush(queue, (loss + own[ranks[i] + 1] - own[ranks[i]], (*ranks[:i], ranks[i] + 1, *ranks[i + 1 :]), i))
        return losses, changes

    def encode_paths(self, values: pa.Array, n: int) -> Iterator[tuple[int, int, float, list[float], bool, list[bytes]]]:
        """Of every text what `encode_all` gives, and the ids of its n best paths, the best first."""
        distinct, codes, offsets = arrowtext.segments(values)
        found = [MARK + s for s in distinct.to_pylist()]
        odd_word = np.array([len(w) == 1 or MARK in w[1:] for w in found], dtype=bool)  # a run of spaces, or a mark in the text
        self.solve([w for w, odd in zip(found, odd_word) if not odd])
        none = Solved((b"", 0, 0.0, math.inf, True))
        rows = [none if odd else self.solved[w] for w, odd in zip(found, odd_word)]
        count, total, loss, same = (np.array([r[k] for r in rows]) for k in (1, 2, 3, 4))
        each = count[codes].astype(np.int64)
        before = np.cumsum(each) - each  # pieces of all words before
        scores = arrowtext.sums(total[codes], offsets)
        bad = arrowtext.sums((~same.astype(bool))[codes].astype(np.int64), offsets)
        odd = arrowtext.sums(odd_word[codes].astype(np.int64), offsets)
        for i in range(len(values)):
            mine = codes[offsets[i] : offsets[i + 1]]
            if odd[i]:
                text = values[i].as_py()
                words = self.words(text)
                self.solve(words)
                got = [self.solved[w] for w in words]
                best = b"".join([g[0] for g in got])
                score, whole = float(sum(g[2] for g in got)), self.join(np.frombuffer(best, "<u4").tolist()).replace(MARK, " ")[1:] == text
                near = sorted(k for _, k in heapq.nsmallest(n - 1, zip((g[3] for g in got), range(len(got)))))
                ends = np.cumsum([g[1] for g in got], dtype=np.int64).tolist()
                spans = [(4 * (ends[k] - got[k][1]), 4 * ends[k]) for k in near]
                losses, changes = self.text_paths([words[k] for k in near], n)
            else:
                best = b"".join([rows[c][0] for c in mine.tolist()])
                score, whole = float(scores[i]), not bad[i]
                k = min(n - 1, len(mine))
                near = np.sort(np.argpartition(loss[mine], k - 1)[:k]) if 0 < k < len(mine) else np.arange(k)
                first = before[offsets[i] + near] - (before[offsets[i]] if len(mine) else 0)
                spans = list(zip((4 * first).tolist(), (4 * (first + each[offsets[i] + near])).tolist()))
                losses, changes = self.text_paths([found[c] for c in mine[near].tolist()], n)
            ids = []
            for change in changes:
                out, at = [], 0
                for k, other in sorted(change.items()):
                    out += [best[at : spans[k][0]], other]
                    at = spans[k][1]
                ids.append(b"".join([*out, best[at:]]) if out else best)
            yield len(best) // 4, zlib.crc32(best), score, losses, bool(whole), ids

    def encode_all(self, values: pa.Array, n: int) -> list[tuple[int, int, float, list[float], bool]]:
        """Of every text: pieces, crc32 of its ids (32 bits, little-endian), best score, losses of the n best paths, round trip."""
        return [row[:5] for row in self.encode_paths(values, n)]


_MODELS: dict[str, PieceModel] = {}


def _ids(rows: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(r) // 4 for r in rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), "<i4")))


def _encoded(doc_ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    outer = np.cumsum([0, *(len(r[5]) for r in rows)]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            doc_ids,
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([round(r[2], 6) for r in rows], pa.float64()),
            pa.array([[round(r[2] - x, 6) for x in r[3]] for r in rows], pa.list_(pa.float64())),
            pa.array([r[4] for r in rows], pa.bool_()),
            _ids([r[5][0] for r in rows]),
            pa.ListArray.from_arrays(pa.array(outer), _ids([x for r in rows for x in r[5]])),
        ],
        ["doc_id", "n_pieces", "ids_crc32", "score", "nbest_scores", "round_trip", "ids", "nbest_ids"],
    )


def _encode_batches(path: str, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _MODELS.get(path) or _MODELS.setdefault(path, PieceModel(path))
        for batch in batches:
            for part in arrowtext.slices(batch):
                rows, size, start = [], 0, 0
                for row in model.encode_paths(arrowtext.texts(part), n):
                    rows.append(row)
                    size += row[0] * len(row[5])
                    if size >= IDS_AT_ONCE:
                        yield _encoded(part.column(0).slice(start, len(rows)), rows)
                        start += len(rows)
                        rows, size = [], 0
                if rows:
                    yield _encoded(part.column(0).slice(start), rows)

    return run


def encode_pieces(docs: DataFrame, model_path: str, n: int = 4) -> DataFrame:
    """Segment every whole text in its n best ways, and decode the best; one row per input row, no shuffle.

    ids are those of the best path (ties to the longer last piece), n_pieces and ids_crc32 of these; nbest_ids the ids of
    the n best paths in order, the best again first, and nbest_scores their scores (fewer where there are fewer);
    round_trip whether decoding gives the text back: a text that holds the mark itself doesn't come back, since the mark
    stands for a space. Null and empty texts have no pieces, score 0; a null doc_id stays null; repeated rows are each
    encoded; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    return only(docs, doc_id="long", text="string").mapInArrow(
        arrowtext.trimmed(_encode_batches(model_path, n)), "doc_id long, n_pieces long, ids_crc32 long, score double, nbest_scores array<double>, round_trip boolean, ids array<int>, nbest_ids array<array<int>>"
    )


def _ids_batches(path: str, encode: bool, merged: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _MODELS.get(path) or _MODELS.setdefault(path, PieceModel(path))
        library = SentencePieceProcessor(model_file=path) if merged else None
        for batch in batches:
            values = batch.column(1).to_pylist()
            if encode:
                out = pa.array([library.encode(v or "") if merged else model.encode(v or "") for v in values], pa.list_(pa.int32()))
            else:
                out = pa.array([None if v is None else model.decode(v) for v in values], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], ["doc_id", "ids" if encode else "text"])

    return run


def encode_ids(docs: DataFrame, model_path: str, merged: bool = False) -> DataFrame:
    """doc_id and ids of every text: of the lattice's best path or, `merged`, in a merge file's own order, as the library
    gives them to every user of the file; null and empty texts have none."""
    small_batches(docs.sparkSession)
    return only(docs, doc_id="long", text="string").mapInArrow(_ids_batches(model_path, True, merged), "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the text of every row of ids; control pieces are silent, null ids give null."""
    return only(encoded, doc_id="long", ids="array<int>").mapInArrow(_ids_batches(model_path, False), "doc_id long, text string")
