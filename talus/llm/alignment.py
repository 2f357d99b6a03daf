"""Alignment of two tokenizers: groups between common token ends, and links of overlapping tokens.

Both tokenizers see a space and the text. Tokenising goes by words: both tokenizers always begin a token at a space that
follows another character and comes before one that isn't white, so what lies between two such places is tokenised,
and aligned, by itself, once for all its occurrences in a worker. Two tokens that overlap share one stretch between
neighbouring ends, so each such stretch is one link; ends on both sides cut the tokens into groups.

A run of documents becomes one row: its distinct links and how often each occurs, its documents with their own numbers, and
which links they hold (packed). Spark sums the links of all runs, finds each B id's highest count and joins both back to
a run's distinct links, so no word or text is shuffled; the sums of a run's documents follow from its row.

Tokenizer A is byte-level BPE by its JSON file, B a SentencePiece model. Special tokens in texts are plain text.

Defined cases: null and empty texts have no tokens, nor have texts whose joined token bytes aren't those
of space and text (B may normalise a character). Repeated rows are separate; an empty table gives no rows; other
columns are kept in ``row``, whatever their names. A run holds about RUN_BYTES of text, one document at least.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.llm.buffers import slices
from talus.llm.line_dedup import small
from talus.session import written

BYTE_BPE, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text in a run; words that a worker remembers at most, and the characters of the longest of them.
RUN_BYTES, MEMORY, LONGEST = 4 << 20, 1 << 18, 64


def byte_of_character() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others as characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """Tokenizer A: ids by the vocabulary's ranks, and the bytes of each id."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        of = byte_of_character()
        special = {x["id"] for x in held.get("added_tokens", [])}
        ranks = {bytes(of[c] for c in piece): i for piece, i in held["model"]["vocab"].items() if i not in special}
        self.sizes = np.zeros(max(held["model"]["vocab"].values()) + 1, np.int32)
        for piece, i in ranks.items():
            self.sizes[i] = len(piece)
        self.codec = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, words: list[str]) -> list[list[int]]:
        """The ids of each word; byte-level tokens always join to a word's own bytes."""
        # words that start like those inside a text are encoded in one go and told apart by their bytes
        inner = [i for i, w in enumerate(words) if len(w) > 1 and not w[1].isspace() and not words[i - 1].endswith(" ")]
        alone = sorted(set(range(len(words))) - set(inner))
        out: list = [None] * len(words)
        for i in alone:
            out[i] = self.codec.encode_ordinary(words[i])
        ids = self.codec.encode_ordinary("".join([words[i] for i in inner]))
        cuts = np.searchsorted(np.cumsum(self.sizes[np.array(ids, np.int32)]), np.cumsum([len(words[i].encode()) for i in inner]))
        begin = 0
        for i, at in zip(inner, (cuts + 1).tolist()):
            out[i] = ids[begin:at]
            begin = at
        return out


class Pieces:
    """Tokenizer B: ids of a word, which the model puts a space before, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bodies = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.sizes = [len(b) for b in self.bodies]
        self.sign = self.model.piece_to_id("▁")

    def ids(self, words: list[str]) -> list[list[int] | None]:
        """The ids of each word (a space at its front); None if their bytes differ from it."""
        out = []
        for w, ids in zip(words, self.model.encode([w[1:] for w in words], num_threads=1)):
            ids = ids or [self.sign]
            out.append(ids if b"".join([self.bodies[i] for i in ids]) == w.encode() else None)
        return out


def words_of(text: str) -> list[str]:
    """Space and text cut before each single space in front of a character that isn't white."""
    parts = text.split(" ")
    if not any(p == "" or p[0].isspace() for p in parts[1:]) and parts[0]:
        return [" " + p for p in parts]
    out = [" " + parts[0]]
    for p in parts[1:]:
        if p and not p[0].isspace() and not out[-1].endswith(" "):
            out.append(" " + p)
        else:
            out[-1] += " " + p
    return out


def word_alignment(a: list[int], b: list[int], a_sizes: list[int], b_sizes: list[int]) -> tuple[int, str, bytes]:
    """(number of groups, ``a1,a2|b1;a3|b2,b3``, links as a << 32 | b) of a word's ids of A and B, which cover the same bytes."""
    links, groups = [], []
    i = j = first_a = first_b = 0
    a_end, b_end = a_sizes[a[0]], b_sizes[b[0]]
    while True:
        links.append(a[i] << 32 | b[j])
        if a_end < b_end:
            i += 1
            a_end += a_sizes[a[i]]
        elif b_end < a_end:
            j += 1
            b_end += b_sizes[b[j]]
        else:
            i, j = i + 1, j + 1
            groups.append(",".join(map(str, a[first_a:i])) + "|" + ",".join(map(str, b[first_b:j])))
            if i == len(a):
                return len(groups), ";".join(groups), np.array(links, np.int64).tobytes()
            first_a, first_b = i, j
            a_end, b_end = a_end + a_sizes[a[i]], b_end + b_sizes[b[j]]


class Tokenizers:
    """Both tokenizers over words, kept by a worker with the alignments of words it has met."""

    def __init__(self, byte_bpe: str, pieces: str):
        self.a, self.b = ByteBpe(byte_bpe), Pieces(pieces)
        self.a_sizes = self.a.sizes.tolist()
        self.known: dict[str, tuple | None] = {}

    def alignments(self, words: list[str]) -> list[tuple | None]:
        """(ids of A, ids of B, groups: their numbers; groups as text, links) of each distinct word, None where B's bytes aren't the word's."""
        known = self.known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > MEMORY:
            known.clear()
            new = words
        for w, a, b in zip(new, self.a.ids(new), self.b.ids(new)):
            known[w] = None if b is None else (len(a), len(b), *word_alignment(a, b, self.a_sizes, self.b.sizes))
        found = [known[w] for w in words]
        if len(known) > MEMORY:
            known.clear()
        for w in new:
            if len(w) > LONGEST:
                known.pop(w, None)
        return found


@lru_cache(maxsize=2)
def _loaded(byte_bpe: str, pieces: str) -> Tokenizers:
    return Tokenizers(byte_bpe, pieces)


def _packed(*columns: np.ndarray) -> bytes:
    """Arrays of 32-bit numbers, compressed; their bytes lie by place, as the upper ones are mostly zero."""
    planes = [np.array([len(c) for c in columns], np.int64).tobytes(), np.concatenate(columns).astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpacked(held: bytes, columns: int) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(held)
    ends = np.cumsum(np.frombuffer(data, np.int64, columns))
    flat = np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=8 * columns).reshape(4, -1).T).view(np.int32).ravel()
    return np.split(flat, ends[:-1])


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The sum of each of the stretches that ``values`` consist of; a stretch may be empty."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(sums[np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])])


_NUMBERS = ("n_a", "n_b", "n_groups")


def run_alignments(docs: DataFrame, digest: bool, keep: list[str], byte_bpe: str = BYTE_BPE, pieces: str = PIECES, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Runs of documents: ``run`` (its number), ``links`` (its distinct ones, a << 32 | b), ``times`` (how often each occurs),
    ``docs`` (``row``, n_a, n_b, n_groups and groups) and ``held`` (which links the documents' words hold, packed)."""
    taken = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, part = _loaded(byte_bpe, pieces), TaskContext.get().partitionId() << 33
        for seq, batch in enumerate(slices(batches, "text", run_bytes)):
            number: dict[str, int] = {}
            of = [[number.setdefault(w, len(number)) for w in words_of(t)] if t else [] for t in batch.column("text").to_pylist()]
            found = both.alignments(list(number))
            bad = {i for i, x in enumerate(found) if x is None}
            if bad:
                of = [[] if bad.intersection(d) else d for d in of]
                found = [x or (0, 0, 0, "", b"") for x in found]
            body = [x[3] for x in found]
            text = [";".join([body[i] for i in d]) for d in of]
            if digest:
                text = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in text]
            lengths = np.array([len(d) for d in of], np.int64)
            flat = np.fromiter((i for d in of for i in d), np.int64, int(lengths.sum()))
            numbers = [_sums(np.array([x[k] for x in found], np.int64)[flat], lengths) for k in range(3)]
            links, at = np.unique(np.frombuffer(b"".join([x[4] for x in found]), np.int64), return_inverse=True)
            n_links = np.array([len(x[4]) // 8 for x in found], np.int64)
            # no sum of these weights is inexact, as they stay below 2**53
            times = np.bincount(at, np.repeat(np.bincount(flat, minlength=len(found)), n_links), len(links)).astype(np.int64)
            every = pa.StructArray.from_arrays([batch.column("row"), *[pa.array(x) for x in numbers], pa.array(text, pa.string())], ["row", *_NUMBERS, "groups"])
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            held = pa.array([_packed(lengths, flat, n_links, at)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([part + seq], pa.int64()), one(pa.array(links)), one(pa.array(times)), one(every), held], ["run", "links", "times", "docs", "held"])

    longs, long, text = T.ArrayType(T.LongType(), False), T.LongType(), T.StringType()
    doc = T.StructType([taken.schema["row"], *[T.StructField(c, long) for c in _NUMBERS], T.StructField("groups", text)])
    return taken.mapInArrow(run, T.StructType([T.StructField("run", long), T.StructField("links", longs), T.StructField("times", longs), T.StructField("docs", T.ArrayType(doc)), T.StructField("held", T.BinaryType())]))


def link_counts(runs: DataFrame) -> DataFrame:
    """(link, count, best) of ``runs``: how many links of all documents hold a pair of ids, and whether no pair of its B id has more."""
    each = runs.select(F.explode(F.arrays_zip("links", "times")).alias("x")).select("x.*").where("times > 0")
    counts = written(each.groupBy(F.col("links").alias("link")).agg(F.sum("times").alias("count")), "links")
    b = F.col("link").bitwiseAND(F.lit((1 << 32) - 1))
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    joined = counts.join(small(most, F.lit(24)), b == F.col("b"))
    return joined.select("link", "count", (F.col("count") == F.col("most")).alias("best"))


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each run with n_best and count_sum, from the run's ``found`` (count and best by place among its links)."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            lengths, flat, n_links, at = _unpacked(row.column("held")[0].as_py(), 4)
            found = row.column("found").flatten()
            # links without a place belong to no document that has tokens
            sums = []
            for name in ("best", "count"):
                values = np.zeros(int(at.max()) + 1 if len(at) else 0, np.int64)
                if len(found):
                    values[found.field("place").to_numpy()] = found.field(name).to_numpy(zero_copy_only=False)
                sums.append(_sums(_sums(values[at], n_links)[flat], lengths))
            docs = row.column("docs").flatten()
            yield pa.RecordBatch.from_arrays([*docs.flatten(), *map(pa.array, sums)], ["row", *_NUMBERS, "groups", "n_best", "count_sum"])


def aligned(docs: DataFrame, digest: bool = False, keep: list[str] | None = None, **paths) -> DataFrame:
    """``row`` (the columns ``keep`` of ``docs``, by default all), n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of
    their B id), count_sum (the counts of its links) and groups (``a1,a2|b1;a3|b2,b3``; empty without tokens; with ``digest`` their SHA-256)."""
    # one pass over the texts; the groups' text stays with its document
    runs = written(run_alignments(docs, digest, docs.columns if keep is None else keep, **paths), "runs")
    counts = link_counts(runs)
    each = runs.select("run", F.posexplode("links").alias("place", "link")).join(small(counts, F.lit(32)), "link")
    found = each.groupBy("run").agg(F.collect_list(F.struct("place", "count", "best")).alias("found"))
    joined = runs.select("run", "docs", "held").join(found, "run", "left")
    doc, long = runs.schema["docs"].dataType.elementType, T.LongType()
    rows = joined.select("docs", "held", F.coalesce("found", F.array().cast(found.schema["found"].dataType)).alias("found")).mapInArrow(
        summed, T.StructType([*doc.fields, T.StructField("n_best", long), T.StructField("count_sum", long)])
    )
    return rows.select("row", "n_a", "n_b", "n_groups", (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links"), "n_best", "count_sum", "groups")
