"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased and reduced to letters and single spaces. Each language has a model of orders 1
to ORDER, estimated from a bounded sample of its documents; all are stored together as arrays sorted
by hash, with one log-probability a language for each known string and one back-off weight a language
for each known context. A text gets the language with the lowest cross-entropy per character. The
score is the softmax of the cross-entropies at the temperature that suits documents outside the
sample best; texts above the highest cross-entropy expected of their language are marked rejected.

Defined cases: a null text or one without letters is ``und`` with score 0 and not rejected; without
training documents all are ``und``; documents without language or id teach nothing; ties go to the
first language by name; rows that repeat a doc_id are judged each by its text; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.buffers import U64, mix, slices
from talus.llm.toxicity import fold

ORDER, BITS = 4, U64(16)
SPACE = 32
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(strings of ORDER characters ending at each position, that position's text, which count).

    A character takes 16 bits; those beyond are folded into them.
    """
    edge = "\0" * ORDER
    joined = edge + edge.join(t.replace("\0", " ") for t in texts) + edge
    points = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letter_table()[points]
    border = points == 0
    keep = letter | border
    keep[1:] |= letter[:-1]  # one space after each word
    text = np.cumsum(border) // ORDER - 1
    points, letter, border, text = points[keep], letter[keep], border[keep], text[keep]
    c = np.where(letter, points, SPACE).astype(U64)
    c = (c ^ (c >> BITS)) & U64(0xFFFF)
    grams = c.copy()
    for back in range(1, ORDER):
        grams[back:] |= c[:-back] << (BITS * U64(back))
    return grams, text, ~border


class Table:
    """Rows of values under 64-bit keys, sorted by hash; the hash's top bits index the places."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashes = mix(keys)
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order]
        bits = max(4, int(len(keys)).bit_length() + 1)
        self.shift = U64(64 - bits)
        self.first = np.searchsorted(self.hashes >> self.shift, np.arange((1 << bits) + 1, dtype=U64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        hashes = mix(keys)
        spot = (hashes >> self.shift).astype(np.int64)
        at, end = self.first[spot], self.first[spot + 1]
        out = np.full(len(keys), -1, np.int32)
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            found = self.hashes[here] == hashes[left]
            out[left[found]] = here[found]
            left = left[~found]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


def _mask(n: int) -> U64:
    return U64((1 << (16 * n)) - 1)


@dataclass
class Counts:
    """Distinct strings of one order with their (continuation) counts, and the contexts' sums."""

    keys: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    sums: np.ndarray
    kinds: np.ndarray
    discount: float


def _counts(keys: np.ndarray, counts: np.ndarray) -> Counts:
    contexts, spot = np.unique(keys >> BITS, return_inverse=True)
    ones, twos = (counts == 1).sum(), (counts == 2).sum()
    discount = float(np.clip(ones / max(1, ones + 2 * twos), 0.1, 0.95))
    return Counts(keys, counts, contexts, np.bincount(spot, counts), np.bincount(spot), discount)


def language_counts(grams: np.ndarray) -> list[Counts]:
    """Kneser-Ney counts by order from 1: raw at the top, distinct left neighbours below."""
    keys, counts = np.unique(grams, return_counts=True)
    out = [_counts(keys, counts)]
    for n in range(ORDER - 1, 0, -1):
        keys, counts = np.unique(keys & _mask(n), return_counts=True)
        out.append(_counts(keys, counts))
    return out[::-1]


def _at(keys: np.ndarray, wanted: np.ndarray, values: np.ndarray, default: float) -> np.ndarray:
    spot = np.searchsorted(keys, wanted)
    spot[spot == len(keys)] = 0
    return np.where(keys[spot] == wanted, values[spot], default)


@dataclass
class Models:
    languages: list[str]
    strings: list[Table]
    backoffs: list[Table]
    unknown: np.ndarray
    limits: np.ndarray
    sharpness: float

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(letters of each text, cross-entropy per character of each text and language)."""
        grams, text, counts = characters(texts)
        at = np.flatnonzero(counts)
        grams, text = grams[at], text[at]
        out = np.zeros((len(grams), len(self.languages)), np.float32)
        left = np.arange(len(grams))
        for n in range(ORDER, 0, -1):
            keys = grams[left] & _mask(n)
            row = self.strings[n - 1].find(keys)
            hit = row >= 0
            out[left[hit]] += self.strings[n - 1].values[row[hit]]
            left, keys = left[~hit], keys[~hit]
            if not len(left):
                break
            row = self.backoffs[n - 1].find(keys >> BITS)
            known = row >= 0
            out[left[known]] += self.backoffs[n - 1].values[row[known]]
        out[left] += self.unknown
        size = np.bincount(text, minlength=len(texts))
        total = np.zeros((len(texts), len(self.languages)))
        if len(text):
            first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            total[text[first]] = np.add.reduceat(out.astype(np.float64), first, axis=0)
        return size, -total / np.maximum(size, 1)[:, None]

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text."""
        size, h = self.entropies(texts)
        best = h.argmin(axis=1)
        with np.errstate(over="ignore"):
            weights = np.exp(-self.sharpness * (h - h.min(axis=1, keepdims=True)))
        score = np.where(size > 0, 1 / weights.sum(axis=1), 0.0)
        rejected = (size > 0) & (h.min(axis=1) > self.limits[best])
        return [self.languages[b] if n else "und" for b, n in zip(best.tolist(), size.tolist())], score, rejected


def estimate(texts: list[str], languages: list[str]) -> Models | None:
    """Models from labelled texts held in memory; every fourth one only calibrates."""
    names = sorted(set(languages))
    if not names:
        return None
    held = np.arange(len(texts)) % 4 == 3
    spoken = np.array([names.index(x) for x in languages])
    for i in range(len(names)):
        if held[spoken == i].all():
            held[spoken == i] = False
    per = []
    for i in range(len(names)):
        grams, _, counted = characters([t for t, s, h in zip(texts, spoken, held) if s == i and not h])
        per.append(language_counts(grams[counted]) if counted.any() else language_counts(np.array([SPACE], U64)))
    alphabet = max(2, len(np.unique(np.concatenate([p[0].keys for p in per]))) + 1)
    strings, backoffs = [], []
    lower_keys, lower = None, None
    for n in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([p[n - 1].keys for p in per]))
        contexts = np.unique(np.concatenate([p[n - 1].contexts for p in per]))
        chance, weight = np.zeros((len(keys), len(names))), np.ones((len(contexts), len(names)))
        for i, p in enumerate(per):
            c = p[n - 1]
            sums = _at(c.contexts, keys >> BITS, c.sums, 1.0)
            kinds = _at(c.contexts, keys >> BITS, c.kinds, 0.0)
            seen = _at(c.keys, keys, c.counts, 0.0)
            share = np.where(kinds > 0, c.discount * kinds / sums, 1.0)
            below = np.full(len(keys), 1 / alphabet) if n == 1 else lower[np.searchsorted(lower_keys, keys & _mask(n - 1)), i]
            chance[:, i] = np.maximum(seen - c.discount, 0) / sums + share * below
            weight[:, i] = _at(c.contexts, contexts, c.discount * c.kinds / c.sums, 1.0)
        strings.append(Table(keys, np.log(chance).astype(np.float32)))
        backoffs.append(Table(contexts, np.log(weight).astype(np.float32)))
        lower_keys, lower = keys, chance
    models = Models(names, strings, backoffs, np.full(len(names), -np.log(alphabet), np.float32), np.full(len(names), np.inf), 1.0)
    check = [i for i in range(len(texts)) if held[i]] or list(range(len(texts)))
    size, h = models.entropies([texts[i] for i in check])
    own = h[np.arange(len(check)), spoken[check]]
    for i in range(len(names)):
        mine = own[(spoken[check] == i) & (size > 20)]
        if len(mine) > 1:
            models.limits[i] = mine.mean() + 6 * mine.std() + 0.05
    fits = {}
    for sharpness in (1.0, 2.0, 5.0, 10.0, 20.0, 50.0):
        z = -sharpness * (h - h.min(axis=1, keepdims=True))
        fits[sharpness] = (z[np.arange(len(check)), spoken[check]] - np.log(np.exp(z).sum(axis=1))).mean()
    models.sharpness = max(fits, key=fits.get)
    return models


def learned(docs: DataFrame, most: int = 400, seed: int = 13) -> Models | None:
    """Models from at most about ``most`` documents a language, drawn by a hash of the id; ``docs``
    has doc_id, text and lang, held-out rows taken away."""
    usable = docs.where("doc_id is not null and lang is not null and text is not null")
    share = F.lit(0.0)
    for lang, n in sorted(usable.groupBy("lang").count().collect()):
        share = F.when(F.col("lang") == lang, min(1.0, most / n)).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < F.lit(1 << 20) * share
    got = usable.where(draw).select("doc_id", "text", "lang").toArrow()
    rows = sorted(zip(got.column("doc_id").to_pylist(), got.column("text").to_pylist(), got.column("lang").to_pylist()))
    return estimate([t for _, t, _ in rows], [g for _, _, g in rows])


def identified(docs: DataFrame, models: Models | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 << 20):
            texts = [t or "" for t in part.column("text").to_pylist()]
            if models is None:
                lang, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            else:
                lang, score, rejected = models.judge(texts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return held.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(doc_id, folds: int = 5):
    return F.coalesce(fold(doc_id, folds) == 0, F.lit(False))
