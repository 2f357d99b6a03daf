"""SentencePiece encoding and decoding on batches of equal-length words.

Words (a run of spaces and what follows it) are taken once a batch and grouped by length, so that
words of one length advance together as a matrix. Hashes of all their substrings probe the sorted
piece keys, which gives a lattice of pieces. Mode ``viterbi`` takes the path of the highest sum of
piece scores: position by position, vectorised maxima store backpointers. That is what a model of
type unigram encodes; for one of type BPE, which stores ranks, the scores are log-probabilities by rank. Mode ``merges`` replays the merges of a model of type BPE on the same lattice,
each step joining every word's best neighbouring pair, and gives the library's ids for such a model.
Characters without a piece become bytes.

Defined cases: a null text is empty and has no pieces; decoding gives back every text except that
U+2581, the model's own sign for a space, comes back as a space; in mode ``merges`` words above LONG
characters are encoded one by one, with the same ids; repeated rows are separate; other columns are
kept in ``row``, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.llm.buffers import BASE, BASE_INVERSE, U64, mix, powers, row_texts
from talus.llm.language import Table
from talus.session import in_python

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SIGN = 0x2581
LONG = 128
SHIFT = 100
_B = U64(BASE)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashes(matrix: np.ndarray) -> np.ndarray:
    """Running polynomial hashes of the rows, from the empty prefix."""
    out = np.zeros((len(matrix), matrix.shape[1] + 1), U64)
    for i in range(matrix.shape[1]):
        out[:, i + 1] = out[:, i] * _B + mix(matrix[:, i].astype(U64) + U64(1))
    return out


@dataclass
class Vocabulary:
    """Pieces by id; ``table`` finds ids by hash."""

    pieces: list[str]
    scores: np.ndarray
    byte_ids: np.ndarray
    viterbi_path: bool
    table: Table
    longest: int
    body: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, pieces: list[str], scores: list[float], kinds: list[str], viterbi_path: bool = True) -> Vocabulary:
        """``kinds``: plain, byte or control for each piece."""
        byte_ids = np.full(256, -1, np.int32)
        plain, bodies = [], []
        for i, (p, k) in enumerate(zip(pieces, kinds)):
            if k == "byte":
                byte_ids[int(p[3:5], 16)] = i
                bodies.append(bytes([int(p[3:5], 16)]))
            elif k == "plain":
                plain.append(i)
                bodies.append(p.replace(chr(SIGN), " ").encode())
            else:
                bodies.append(b"")
        keys = np.zeros(len(plain), U64)
        for length in {len(pieces[i]) for i in plain}:
            at = [j for j, i in enumerate(plain) if len(pieces[i]) == length]
            keys[at] = _hashes(np.stack([_points(pieces[plain[j]]) for j in at]))[:, -1]
        offsets = np.cumsum([0, *map(len, bodies)])
        body = np.frombuffer(b"".join(bodies), np.uint8)
        return cls(pieces, np.array(scores, np.float64), byte_ids, viterbi_path, Table(keys, np.array(plain, np.int32)), max(len(pieces[i]) for i in plain), body, offsets)

    @classmethod
    def load(cls, path: str = MODEL, mode: str = "viterbi") -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(m.get_piece_size())
        kinds = ["byte" if m.is_byte(i) else "control" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "plain" for i in n]
        scores = np.array([m.get_score(i) for i in n])
        if mode == "viterbi" and (scores == np.round(scores)).all():
            # a BPE model stores ranks, which don't add up along a path: log-probabilities by their Zipf-Mandelbrot law
            scores = -np.log(SHIFT + np.abs(scores))
        return cls.of([m.id_to_piece(i) for i in n], scores, kinds, mode == "viterbi")

    def lattice(self, words: np.ndarray) -> np.ndarray:
        """(words, start, length - 1): the id of each substring, or -1."""
        n, size = words.shape
        most = min(size, self.longest)
        sums = _hashes(words)
        out = np.full((n, size, most), -1, np.int32)
        power = powers(BASE, most + 1)
        for length in range(1, most + 1):
            keys = sums[:, length:] - sums[:, :-length] * power[length]
            row = self.table.find(keys.ravel())
            ids = np.where(row >= 0, self.table.values[np.maximum(row, 0)], -1)
            out[:, : size - length + 1, length - 1] = ids.reshape(n, -1)
        return out

    def viterbi(self, words: np.ndarray) -> np.ndarray:
        """(words, end): the start of the last piece of the best path to each position."""
        n, size = words.shape
        ids = self.lattice(words)
        worst = float(self.scores.min()) - 10.0
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, size + 1), np.int32)
        for end in range(1, size + 1):
            lengths = np.arange(1, min(end, ids.shape[2]) + 1)
            piece = ids[:, end - lengths, lengths - 1]
            score = np.where(piece >= 0, self.scores[piece], -np.inf)
            score[:, 0] = np.where(piece[:, 0] >= 0, score[:, 0], worst)
            score += best[:, end - lengths]
            pick = score[:, ::-1].argmax(axis=1)  # the longest of equals
            pick = len(lengths) - 1 - pick
            best[:, end] = score[np.arange(n), pick]
            back[:, end] = end - lengths[pick]
        starts = np.zeros((n, size), bool)
        at = np.full(n, size)
        while (at > 0).any():
            live = np.flatnonzero(at > 0)
            at[live] = back[live, at[live]]
            starts[live, at[live]] = True
        return starts

    def merges(self, words: np.ndarray) -> np.ndarray:
        """(words, position): where a piece starts after all merges."""
        n, size = words.shape
        ids = self.lattice(words)
        most = ids.shape[2]
        starts = np.ones((n, size), bool)
        follow = np.tile(np.arange(1, size + 1), (n, 1))
        live = np.arange(n)
        while len(live) and size > 1:
            nxt = follow[live]
            second = np.take_along_axis(np.column_stack([nxt, np.full(len(live), size)]), nxt, axis=1)
            span = second - np.arange(size)
            fits = starts[live] & (nxt < size) & (span <= most)
            piece = ids[live[:, None], np.arange(size), np.minimum(span, most) - 1]
            score = np.where(fits & (piece >= 0), self.scores[piece], -np.inf)
            pick = score.argmax(axis=1)
            row = np.arange(len(live))
            joined = score[row, pick] > -np.inf
            live, pick, row = live[joined], pick[joined], row[joined]
            starts[live, nxt[row, pick]] = False
            follow[live, pick] = second[row, pick]
        return starts

    def one_by_one(self, word: np.ndarray) -> np.ndarray:
        """Merges of one long word with a heap."""
        text = word.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        lookup = self._lookup()
        size = len(text)
        follow, before = list(range(1, size + 1)), list(range(-1, size - 1))
        gone = bytearray(size)
        heap: list = []

        def offer(i):
            j = follow[i]
            if j < size and follow[j] - i <= self.longest and (p := lookup.get(text[i : follow[j]])) is not None:
                heapq.heappush(heap, (-self.scores[p], i, j, follow[j]))

        for i in range(size - 1):
            offer(i)
        while heap:
            _, i, j, end = heapq.heappop(heap)
            if gone[i] or follow[i] != j or j >= size or gone[j] or follow[j] != end:
                continue
            gone[j] = 1
            follow[i] = end
            if end < size:
                before[end] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return ~np.frombuffer(gone, np.uint8).astype(bool)

    def _lookup(self) -> dict[str, int]:
        if not hasattr(self, "_ids"):
            self._ids = {self.pieces[i]: int(i) for i in self.table.values}
        return self._ids

    def split(self, words: np.ndarray) -> np.ndarray:
        if self.viterbi_path:
            return self.viterbi(words)
        return np.stack([self.one_by_one(w) for w in words]) if words.shape[1] > LONG else self.merges(words)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets)."""
        # a space before every text; a text of no characters stays without pieces
        joined = "".join(" " + t for t in texts if t)
        points = _points(joined).copy()
        points[points == 0x20] = SIGN
        sizes = np.array([len(t) + 1 if t else 0 for t in texts])
        edges = np.concatenate([[0], np.cumsum(sizes)])
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        sign = points == SIGN
        new = np.zeros(len(points), bool)
        new[0] = True
        new[1:] = sign[1:] & ~sign[:-1]
        new[edges[:-1][sizes > 0]] = True
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(points))
        size = end - start
        sums = np.zeros(len(points) + 1, U64)
        np.cumsum(mix(points.astype(U64) + U64(7)) * powers(BASE, len(points)), out=sums[1:])
        keys = mix((sums[end] - sums[start]) * powers(BASE_INVERSE, len(sums))[start] + size.astype(U64))
        _, first, kind = np.unique(keys, return_index=True, return_inverse=True)
        cuts_row, cuts_at, cuts_len = [], [], []
        sizes_of = size[first]
        for length in np.unique(sizes_of):
            who = np.flatnonzero(sizes_of == length)
            step = max(1, 2_000_000 // (int(length) * min(int(length), self.longest)))
            for lo in range(0, len(who), step):
                part = who[lo : lo + step]
                words = points[start[first[part]][:, None] + np.arange(length)]
                row, at = np.nonzero(self.split(words))
                stop = np.append(at[1:], 0)
                stop[np.append(row[1:] != row[:-1], True)] = length
                cuts_row.append(part[row])
                cuts_at.append(start[first[part[row]]] + at)
                cuts_len.append(stop - at)
        row, at, length = map(np.concatenate, (cuts_row, cuts_at, cuts_len))
        order = np.argsort(row, kind="stable")
        row, at, length = row[order], at[order], length[order]
        ids, count = self._ids_of(points, at, length)
        per_row = np.bincount(row, count, minlength=len(first)).astype(np.int64)
        begin = np.cumsum(per_row) - per_row
        amount = per_row[kind]
        total = np.cumsum(amount)
        out = ids[np.arange(total[-1]) - np.repeat(total - amount - begin[kind], amount)]
        text = np.searchsorted(edges, start, "right") - 1
        per_text = np.bincount(text, amount, minlength=len(texts)).astype(np.int64)
        return out, np.concatenate([[0], np.cumsum(per_text)])

    def _ids_of(self, points: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each): pieces of ``points``, bytes for a character without one."""
        ids = np.full(len(at), -1, np.int32)
        for n in np.unique(length):
            who = np.flatnonzero(length == n)
            keys = _hashes(points[at[who][:, None] + np.arange(n)])[:, -1]
            row = self.table.find(keys)
            ids[who] = np.where(row >= 0, self.table.values[np.maximum(row, 0)], -1)
        count = np.ones(len(at), np.int64)
        bare = np.flatnonzero(ids < 0)
        if not len(bare):
            return ids, count
        encoded = [chr(p).encode("utf-8", "surrogatepass") for p in points[at[bare]].tolist()]
        count[bare] = [len(b) for b in encoded]
        out = np.repeat(ids, count)
        first = (np.cumsum(count) - count)[bare]
        spot = np.repeat(first - np.cumsum(count[bare]) + count[bare], count[bare]) + np.arange(count[bare].sum())
        out[spot] = self.byte_ids[np.frombuffer(b"".join(encoded), np.uint8)]
        return out, count

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each run of ids."""
        size = (self.offsets[1:] - self.offsets[:-1])[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        body = self.body[np.arange(total[-1]) - np.repeat(total[:-1] - self.offsets[ids], size)].tobytes()
        ends = total[offsets].tolist()
        return [body[a + 1 : b] if b > a else b"" for a, b in zip(ends[:-1], ends[1:])]


def encoded(docs: DataFrame, path: str = MODEL, mode: str = "viterbi") -> DataFrame:
    """``row`` (all columns of ``docs``), piece_ids array<int> and decoded (the text that they give back, as bytes)."""
    vocabulary = Vocabulary.load(path, mode)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, texts in row_texts(batches, 1 << 20):
            ids, offsets = vocabulary.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            back = pa.array(vocabulary.decode(ids, offsets), pa.binary())
            yield pa.RecordBatch.from_arrays([row, lists, back], ["row", "piece_ids", "decoded"])

    made = T.StructType().add("piece_ids", T.ArrayType(T.IntegerType())).add("decoded", T.BinaryType())
    return in_python(held, run, T.StructType([held.schema["row"], *made.fields]))
