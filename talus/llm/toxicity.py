"""Toxicity by a gap-weighted subsequence kernel SVM on Nystroem landmarks.

A document is a bag of sentences, a sentence a run of units: tokens between white space, where
spelled-out letters ("i d i o t") count as one. The kernel compares units by their subsequences of four
letters, digits or borders (a unit has one before and one behind it). Each one may skip up to two letters, which weigh DECAY each, and any number of marks
or spaces, which weigh MARK_DECAY each (symbol-dependent decay), so dotted, starred and spaced-out words
stay near the plain one. Two neighbours within a sentence are compared as one unit too ("id iot"). A
sentence scores as its most toxic unit or pair, a document as its most toxic sentence.

Training sees labelled documents as bags of sentences. Units that go with toxic ones beyond chance,
counted by the distinct words before them so that copies count once, and their gapped forms are the positive
examples, units of clean ones the negative ones; both and the SVM are found anew for a few rounds. It
runs in one task on a sample bounded in rows and characters, never in the driver.

Landmarks enter the decision only through sums of their quadruples, so a trained model is one weight
for each number of a quadruple of character classes, and a text is scored in one pass over its letters.

Defined cases: a null or empty text has the lowest score a text can have; units above 24 letters
are learned and scored in overlapping runs of 24, one from every twelfth letter; with labels of one class alone every score is 0 or 1; labels without
id or value are ignored, repeated ones count as toxic if any is; rows that repeat a doc_id are scored
each by its text; other columns are kept in ``row``, whatever their names.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.llm.buffers import mix, row_texts
from talus.session import in_python, written

DECAY, MARK_DECAY = 0.6, 0.92
COST = 0.2
#: The places of a quadruple's other letters after its first, by the last one's place.
SHAPES = {last: [(j, k) for j in range(1, last) for k in range(j + 1, last)] for last in (3, 4, 5)}
CLASSES, NUMBERS = 64, 1 << 20
BORDER, MARK, RUN = 0, 63, 12
GAPS = np.float32(MARK_DECAY) ** np.arange(64, dtype=np.float32)
_tables: list[np.ndarray] = []


def class_table() -> np.ndarray:
    """A character class for each code point: letters and digits 1 to 62, marks 63, white space 0."""
    if not _tables:
        table = np.full(0x110000, MARK, np.uint8)
        for cp in range(0x3000):
            c = chr(cp)
            if "a" <= c <= "z":
                table[cp] = 1 + cp - ord("a")
            elif c.isalnum():
                table[cp] = 27 + cp % 36
        letters = np.arange(0x3000, 0x110000)
        table[0x3000:] = 27 + letters % 36
        table[[0, 0x20, *range(0x09, 0x0E)]] = BORDER
        _tables.append(table)
    return _tables[0]


@dataclass
class Units:
    """The letters of many texts, the units that they form, and the runs that units are scored in."""

    joined: str
    at: np.ndarray  # a letter's place in ``joined``
    classes: np.ndarray
    gaps: np.ndarray  # marks and spaces before a letter
    unit: np.ndarray
    start: np.ndarray
    size: np.ndarray
    text: np.ndarray
    sentence: np.ndarray
    #: The letters with a border before each unit and after the last, where a unit starts in them, and
    #: the marks before each symbol as the first and as the last one of a quadruple.
    symbols: np.ndarray
    lead: np.ndarray
    gaps_first: np.ndarray
    gaps_last: np.ndarray
    run_start: np.ndarray
    run_unit: np.ndarray

    @property
    def pairable(self) -> np.ndarray:
        """Whether a unit and the next one are compared as one."""
        out = np.zeros(len(self.start), bool)
        out[:-1] = (self.sentence[1:] == self.sentence[:-1]) & (self.size[1:] + self.size[:-1] <= 2 * RUN)
        return out


def units(texts: list[str], whole: bool = False) -> Units:
    """The units of ``texts``; with ``whole`` each text is one."""
    joined = ("\0" + "\0".join(t.replace("\0", " ") for t in texts) + "\0\0").lower()
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = class_table()[points]
    border = classes == BORDER
    at = np.flatnonzero(~border & (classes != MARK))
    owner = np.searchsorted(np.flatnonzero(points == 0), at) - 1
    new = np.ones(len(at), bool)
    if whole:
        new[1:] = owner[1:] != owner[:-1]
    elif len(at):
        spaces = np.cumsum(border)[at]
        new[1:] = spaces[1:] != spaces[:-1]
        start = np.flatnonzero(new)
        single = np.diff(start, append=len(at)) == 1
        joins = start[1:][single[1:] & single[:-1] & (owner[start[1:]] == owner[start[:-1]])]
        new[joins] = False
    start = np.flatnonzero(new)
    size = np.diff(start, append=len(at))
    stop = (points == 0) | (points == 0x0A) | np.isin(points, (0x3002, 0xFF01, 0xFF1F))
    stop[:-1] |= np.isin(points[:-1], (0x21, 0x2E, 0x3F)) & border[1:]
    sentence = np.cumsum(stop)[at[start]] if len(start) else np.zeros(0, int)
    unit, gaps, found = np.cumsum(new) - 1, (at - np.arange(len(at))).astype(np.int32), classes[at].astype(np.uint32)
    spot, lead = np.arange(len(at)) + unit + 1, start + np.arange(len(start))
    symbols = np.full(len(at) + len(start) + 1, BORDER, np.uint32)
    symbols[spot] = found
    first, last = np.zeros(len(symbols), np.int32), np.zeros(len(symbols), np.int32)
    first[spot] = last[spot] = gaps
    first[lead], last[lead[1:]], last[-1:] = gaps[start], gaps[start[1:] - 1], gaps[-1:] if len(gaps) else 0
    runs = -(-size // RUN)
    run_unit = np.repeat(np.arange(len(start)), runs)
    nth = np.arange(len(run_unit)) - np.repeat(np.cumsum(runs) - runs, runs)
    run_start = lead[run_unit] + np.where(nth > 0, RUN * nth + 1, 0)
    return Units(joined, at, found, gaps, unit, start, size, owner[start], sentence, symbols, lead, first, last, run_start, run_unit)


def _numbers(c: np.ndarray, j: int, k: int, last: int) -> np.ndarray:
    """The quadruples' numbers of one shape, at all first places."""
    m = len(c) - last
    return _number(c[:m], c[j : m + j], c[k : m + k], c[last:])


def _number(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    number = (((a * np.uint32(CLASSES) + b) * np.uint32(CLASSES) + c) * np.uint32(CLASSES) + d) * np.uint32(2654435769)
    return number >> np.uint32(12)


def _weight(first: np.ndarray, end: np.ndarray, last: int) -> np.ndarray:
    """The weight of skipped letters and gaps, at all first places."""
    return GAPS[np.minimum(end[last:] - first[:-last], len(GAPS) - 1)] * np.float32(DECAY ** (last - 3))


def _room(u: Units) -> np.ndarray:
    """How many symbols of its own unit, the border behind it among them, follow each symbol."""
    room = np.repeat(np.append(u.lead[1:], len(u.symbols) - 1), u.size + 1)
    return np.append(room, 0) - np.arange(len(u.symbols))


def _lengths_norm() -> np.ndarray:
    """The kernel norm of a unit of each length without marks, counting each quadruple's place once."""
    out = np.ones(2 * RUN + 1)
    for n in range(1, 2 * RUN + 1):
        out[n] = np.sqrt(sum(len(shapes) * DECAY ** (2 * (last - 3)) * max(0, n + 2 - last) for last, shapes in SHAPES.items()) or 1)
    return out


NORMS = _lengths_norm()


def unit_scores(u: Units, weights: np.ndarray) -> np.ndarray:
    """The weights' sum over each unit's quadruples over its norm: the best of its runs and of it with the next."""
    if not len(u.start):
        return np.zeros(0)
    inside, across = np.zeros(len(u.symbols), np.float32), np.zeros(len(u.classes), np.float32)
    pairable, room = u.pairable, _room(u)
    for last, shapes in SHAPES.items():
        m = len(u.symbols) - last
        if m <= 0:
            continue
        value = np.zeros(m, np.float32)
        for j, k in shapes:
            value += weights[_numbers(u.symbols, j, k, last)]
        inside[:m] += np.where(room[:m] >= last, value * _weight(u.gaps_first, u.gaps_last, last), np.float32(0))
        m = len(u.classes) - last
        if m <= 0:
            continue
        # subsequences that begin in one unit and end in the next
        at = np.flatnonzero((u.unit[last:] - u.unit[:m] == 1) & pairable[u.unit[:m]])
        c = [u.classes[at + i] for i in range(last + 1)]
        value = np.zeros(len(at), np.float32)
        for j, k in shapes:
            value += weights[_number(c[0], c[j], c[k], c[last])]
        across[at] += value * GAPS[np.minimum(u.gaps[at + last] - u.gaps[at], len(GAPS) - 1)] * np.float32(DECAY ** (last - 3))
    # whole numbers: equal units get equal sums wherever they stand
    inside, across = (np.rint(x * np.float32(1 << 20)).astype(np.int64) for x in (inside, across))
    runs = np.add.reduceat(inside, u.run_start)
    pair = runs.copy()
    same = u.run_unit[1:] == u.run_unit[:-1]
    pair[:-1] += np.where(same, runs[1:], 0)
    best = np.maximum.reduceat(pair, np.flatnonzero(np.append(True, ~same))) / (NORMS[np.minimum(u.size, 2 * RUN)] * (1 << 20))
    own = np.add.reduceat(inside, u.lead)
    both = own + np.add.reduceat(across, u.start)
    both[:-1] += own[1:]
    both = both / (NORMS[np.minimum(u.size + np.append(u.size[1:], 0), 2 * RUN)] * (1 << 20))
    return np.where(pairable, np.maximum(best, both), best)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, quadruple, value): the words' normalised feature vectors, each word one unit."""
    u = units(words, whole=True)
    rows, cols, values = [np.zeros(0, int)], [np.zeros(0, np.int32)], [np.zeros(0)]
    room, unit = _room(u), np.append(np.repeat(np.arange(len(u.size)), u.size + 1), len(u.size))
    for last, shapes in SHAPES.items():
        if len(u.symbols) <= last:
            continue
        at = np.flatnonzero(room[:-last] >= last)
        weight = _weight(u.gaps_first, u.gaps_last, last)[at]
        for j, k in shapes:
            rows.append(unit[at])
            cols.append(_numbers(u.symbols, j, k, last)[at].astype(np.int32))
            values.append(weight)
    rows, cols, values = map(np.concatenate, (rows, cols, values))
    return u.text[rows], cols, values / NORMS[np.minimum(u.size, 2 * RUN)][rows]


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Stretches of ``texts`` of a quarter of a megabyte, one text at least."""
    sizes = np.cumsum([len(x) for x in texts])
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + (1 << 18), "right")))
        yield lo, hi
        lo = hi


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def best(self, texts: list[str]) -> np.ndarray:
        """Each text's highest unit score."""
        best = np.full(len(texts), -2.0)
        for lo, hi in _parts(texts):
            u = units(texts[lo:hi])
            if len(u.start):
                np.maximum.at(best, lo + u.text, unit_scores(u, self.weights) + self.bias)
        return best

    def chance(self, best: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.shift, -30, 30)))

    def score(self, texts: list[str]) -> np.ndarray:
        return self.chance(self.best(texts))

    def sentences(self, text: str) -> list[tuple[str, float]]:
        """The sentences of a text that hold letters, each with its own score."""
        u = units([text])
        if not len(u.start):
            return []
        score = self.chance(unit_scores(u, self.weights) + self.bias)
        first = np.flatnonzero(np.append(True, u.sentence[1:] != u.sentence[:-1]))
        last = np.append(first[1:], len(u.start)) - 1
        ends = u.at[u.start[last] + u.size[last] - 1] + 1
        return [(u.joined[a:b], float(s)) for a, b, s in zip(u.at[u.start[first]].tolist(), ends.tolist(), np.maximum.reduceat(score, first))]


def _words(texts: list[str]) -> Iterator[tuple[int, str]]:
    """(text, word) of all units in order; those above 24 letters as the overlapping runs they are scored in."""
    for lo, hi in _parts(texts):
        u = units(texts[lo:hi])
        last = len(u.at) - 1
        for text, start, size in zip((lo + u.text).tolist(), u.start.tolist(), u.size.tolist()):
            for at in range(start, max(start + 1, start + size - RUN), RUN):
                yield text, u.joined[u.at[at] : u.at[min(last, start + size - 1, at + 2 * RUN - 1)] + 1]


def _vocabulary(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words by name, and for each of their places the word, a hash of the three before it and the text)."""
    number: dict[str, int] = {}
    word, text = array("i"), array("i")
    for t, w in _words(texts):
        word.append(number.setdefault(w, len(number)))
        text.append(t)
    words = sorted(number)
    rank = np.empty(len(words), np.int64)
    rank[[number[w] for w in words]] = np.arange(len(words))
    word, text = rank[np.frombuffer(word, np.int32)] if words else np.zeros(0, int), np.array(text, np.int32)
    before = np.zeros(len(word), np.uint64)
    for back in (1, 2, 3):
        held = np.zeros(len(word), np.uint64)
        held[back:] = np.where(text[back:] == text[:-back], word[:-back] + 1, 0)
        before = mix(before + held)
    return words, word, before, text


def gapped(word: str) -> list[str]:
    """Forms of a word with inserted, doubled, replaced and spaced-out characters."""
    n, half = len(word), len(word) // 2
    out = [" ".join(word), word[:half] + "*" + word[half:], word[:half] + "x" + word[half:], word[:half] + " " + word[half:]]
    for p in sorted({1, half, n - 2} & set(range(1, n - 1))):
        out += [word[:p] + "0" + word[p + 1 :], word[:p] + "*" + word[p + 1 :], word[: p + 1] + word[p:]]
    return out


def _squared_hinge(z: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Newton steps on the primal of the squared-hinge SVM; the last column of z is the bias."""
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-3

    y, cost = y.astype(np.float32), cost.astype(np.float32)

    def loss(v):
        return v @ ridge @ v + (cost * np.maximum(0, 1 - y * (z @ v.astype(np.float32))) ** 2).sum(dtype=np.float64)

    now = loss(w)
    for _ in range(rounds):
        active = np.flatnonzero(y * (z @ w.astype(np.float32)) < 1)
        square, side = ridge.copy(), np.zeros(z.shape[1])
        for lo in range(0, len(active), 4096):
            part = z[active[lo : lo + 4096]].astype(np.float64)
            weighed = part * cost[active[lo : lo + 4096], None]
            square += weighed.T @ part
            side += weighed.T @ y[active[lo : lo + 4096]]
        step = np.linalg.solve(square, side) - w
        size = 1.0
        while size > 1e-3 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        before, now = now, loss(w)
        if before - now < 1e-6 * before:
            break
    return w


def _landmark_table(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of quadruples, their values in each landmark)."""
    row, col, value = features(words)
    kinds = np.unique(col)
    table = np.zeros((len(kinds), len(words)), np.float32)
    np.add.at(table, (np.searchsorted(kinds, col), row), value)
    return kinds, table


def _kernel(words: list[str], kinds: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Kernel values of words and landmarks, a few thousand words at a time."""
    out = np.zeros((len(words), table.shape[1]), np.float32)
    for lo in range(0, len(words), 2000):
        row, col, value = features(words[lo : lo + 2000])
        spot = np.searchsorted(kinds, col)
        spot[spot == len(kinds)] = 0
        known = kinds[spot] == col
        row, spot, value = row[known], spot[known], value[known]
        order = np.argsort(row, kind="stable")
        for at in range(0, len(order), 20_000):
            part = order[at : at + 20_000]
            heads, starts = np.unique(row[part], return_index=True)
            out[lo + heads] += np.add.reduceat(table[spot[part]] * value[part, None].astype(np.float32), starts, axis=0)
    return out


def train(
    texts: list[str],
    labels: np.ndarray,
    shares: tuple[float, float] = (1.0, 1.0),
    landmarks: int = 192,
    rounds: int = 4,
    seed: int = 5,
    frequent_clean: int = 5000,
    hard_clean: int = 2500,
    drawn_clean: int = 20_000,
) -> Model:
    """Fit on labelled texts held in memory; the caller bounds them.

    ``shares`` are the sampled parts of the clean and the toxic class, which the curve to probabilities
    makes good. Negative examples are the ``frequent_clean`` most frequent words, in each round the
    ``hard_clean`` that look most toxic, and ``drawn_clean`` drawn ones.
    """
    r = np.random.default_rng(seed)
    empty = np.zeros(NUMBERS, np.float32)
    if not len(texts) or labels.all() or not labels.any():
        return Model(empty, 0.0, 0.0, 30.0 if len(texts) and labels.all() else -30.0)
    # a third of the texts only sets the curve from scores to probabilities
    held = np.arange(len(texts)) % 3 == 2
    if labels[~held].all() or not labels[~held].any() or labels[held].all() or not labels[held].any():
        held[:] = False
    check_texts, check = ([t for t, h in zip(texts, held) if h], labels[held]) if held.any() else (texts, labels)
    texts, labels = [t for t, h in zip(texts, held) if not h], labels[~held]
    words, word, before, text = _vocabulary(texts)
    if not words:
        return Model(empty, 0.0, 0.0, float(np.log(labels.mean() / (1 - labels.mean()))))
    # a word counts once for the same words before it, so copies of a passage count once, and once for a text
    kinds_of = lambda key, side: np.bincount(word[side][np.unique(key[side], return_index=True)[1]], minlength=len(words))
    keys = [mix(mix(word.astype(np.uint64)) + x) for x in (before, text.astype(np.uint64))]
    toxic, clean = (np.minimum(*[kinds_of(key, side) for key in keys]).astype(float) for side in (labels[text], ~labels[text]))
    del word, before, text, keys
    total = toxic + clean
    share = min(0.9, max(0.01, toxic.sum() / total.sum()))
    # evidence of a word's tie to toxic documents: the log-likelihood ratio of its counts
    with np.errstate(divide="ignore", invalid="ignore"):
        evidence = np.where(toxic > 0, toxic * np.log(toxic / total / share), 0) + np.where(clean > 0, clean * np.log(clean / total / (1 - share)), 0)
    evidence = np.where(toxic > total * share, evidence, 0.0)
    pure = toxic / (toxic + clean * share / (1 - share) + 0.25) >= 0.9
    lead = evidence.copy()
    # so tied by chance: fewer than one in three among the words that are as frequent
    alike = np.bincount(total.astype(int))[total.astype(int)]
    sure = np.flatnonzero(pure & (alike * np.exp(-evidence) < 0.3) & (toxic > 1))
    if not len(sure):
        sure = np.argsort(-evidence, kind="stable")[:8]
        sure = sure[evidence[sure] > 0]
    if not len(sure):
        return Model(empty, 0.0, 0.0, float(np.log(labels.mean() / (1 - labels.mean()))))
    witness = sure
    frequent = np.argsort(-clean, kind="stable")[:frequent_clean]
    mined = near = np.zeros(0, int)
    for _ in range(rounds):
        weight = toxic[witness]
        marks = witness[np.argsort(-weight, kind="stable")[: landmarks // 2]]
        negative = np.flatnonzero((clean > 0) & ~pure)
        hard = negative[np.argsort(-lead[negative], kind="stable")[:hard_clean]]
        mined = np.union1d(mined, hard)
        negative = np.unique(np.concatenate([mined, np.intersect1d(frequent, negative), negative[r.permutation(len(negative))[:drawn_clean]]]))
        # the common clean words that looked most toxic in any round
        common = frequent[clean[frequent] > 0]
        common = common[~pure[common]]
        near = np.union1d(near, common[np.argsort(-lead[common], kind="stable")[: landmarks // 3]])
        marks = np.concatenate([marks, near])
        # the likeliest insults also in their gapped forms
        plain = witness[np.argsort(-weight, kind="stable")[:200]]
        plain = [(form, toxic[i] / 4) for i in plain if 4 <= len(words[i]) <= 2 * RUN for form in gapped(words[i])]
        used = np.concatenate([marks, witness, negative])
        kinds, table = _landmark_table([words[i] for i in marks])
        kernel = _kernel([*[words[i] for i in used], *[form for form, _ in plain]], kinds, table)
        square = kernel[: len(marks)]
        values, vectors = np.linalg.eigh((square + square.T).astype(np.float64) / 2)
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        z = np.column_stack([kernel[len(marks) :] @ root.astype(np.float32), np.ones(len(kernel) - len(marks), np.float32)])
        y = np.concatenate([np.ones(len(witness)), -np.ones(len(negative)), np.ones(len(plain))])
        # an example weighs as the places that hold it; y has the gapped forms last
        cost = COST * np.concatenate([weight, 1 + clean[negative], np.array([w for _, w in plain])])
        w = _squared_hinge(z, y, cost)
        weights = empty.astype(np.float64)
        weights[kinds] = table @ (root @ w[:-1])
        bias = float(w[-1])
        lead = Model(weights.astype(np.float32), bias, 1.0, 0.0).best(words)
        witness = np.union1d(sure, np.flatnonzero(pure & (evidence > 4) & (lead > 0.5)))
    model = Model(weights.astype(np.float32), bias, 1.0, 0.0)
    return Model(model.weights, bias, *_platt(model.best(check_texts), check, shares))


def _platt(best: np.ndarray, labels: np.ndarray, shares: tuple[float, float] = (1.0, 1.0)) -> tuple[float, float]:
    """Slope and shift of the logistic curve through document scores, by damped Newton steps.

    A row of a class that was sampled by ``shares`` stands for as many more rows.
    """
    x = np.column_stack([best, np.ones(len(best))])
    each = np.where(labels, 1 / shares[1], 1 / shares[0])
    each = each * len(each) / each.sum()
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (each * (p * (1 - p) + 1e-6))[:, None]) + 0.1 * np.eye(2), x.T @ (each * (p - labels)) + 0.1 * w)
        w = w - 0.5 * step
        if np.abs(step).max() < 1e-6:
            break
    return float(max(w[0], 0.0)), float(w[1])


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, most_chars: int, seed: int = 11) -> tuple[DataFrame, tuple[float, float]]:
    """(doc_id, text, label) of about ``most`` labelled texts of each class and ``most_chars`` characters
    at most, drawn by a hash of the id, and the drawn shares of the clean and the toxic class."""
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = dict(known.groupBy(F.col("label") == 1).count().collect())
    shares = tuple(min(1.0, most / max(1, counts.get(kind, 0))) for kind in (False, True))
    share = F.when(F.col("label") == 1, shares[1]).otherwise(shares[0])
    draw = lambda factor: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < F.lit(1 << 20) * share * factor
    # bounded by ``most`` rows a class, so that it can be broadcast
    picked = known.where(draw(1.0)).limit(4 * most)
    got = written(docs.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label"), "labelled")
    size = got.agg(F.sum(F.length("text"))).first()[0] or 0
    factor = min(1.0, most_chars / max(1, size))
    return got.where(draw(factor)), (shares[0] * factor, shares[1] * factor)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` (all columns of ``docs``) and score."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, texts in row_texts(batches, 1 << 20):
            yield pa.RecordBatch.from_arrays([row, pa.array(model.score(texts))], ["row", "score"])

    return in_python(held, run, T.StructType([held.schema["row"], T.StructField("score", T.DoubleType())]))


def fitted(docs: DataFrame, labels: DataFrame, most: int = 2000, most_chars: int = 8 << 20, **options) -> Model:
    """A model from the labelled documents whose fold of four is not 2; ``labels`` (doc_id, label), ``options`` of ``train``.

    The sample, of ``most`` rows a class and ``most_chars`` characters, is gathered in one task.
    """
    allowed = labels.where(fold(F.col("doc_id"), 4) != 2)
    sample, shares = labelled_sample(docs.select("doc_id", F.col("text").cast("string").alias("text")), allowed, most, most_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = pa.Table.from_batches(batches).to_pydict() if (batches := list(batches)) else {"doc_id": [], "text": [], "label": []}
        rows = sorted(zip(columns["doc_id"], (t or "" for t in columns["text"]), (y == 1 for y in columns["label"])))
        del columns
        model = train([t for _, t, _ in rows], np.array([y for *_, y in rows], bool), shares, **options)
        yield pa.RecordBatch.from_pydict({"weights": [model.weights.tobytes()], "curve": [[model.bias, model.slope, model.shift]]})

    found = sample.repartition(1).mapInArrow(run, "weights binary, curve array<double>").first()
    if found is None:
        return train([], np.zeros(0, bool))
    return Model(np.frombuffer(found.weights, np.float32), *found.curve)
