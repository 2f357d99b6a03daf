"""MinHash near-duplicate groups with sequential Bayesian verification.

Documents with equal shingle sets form one class, so copies are never paired. Class signatures are
banded; in every band bucket all classes are compared with the bucket's smallest one. The classes of
buckets that then still hold several components are bucketed anew by the rarest items of their sets:
two sets of the wanted similarity share one of the first n - ceil(0.8 n) + 1 in order of rarity, so
large groups of copies below the threshold are not paired off. Buckets are worked off by further
smallest members until each holds a single component.
Each candidate pair is compared by batches of its signatures, dropped once the posterior chance of
the threshold falls under the chosen miss probability, and confirmed on the full sets.

Defined cases: null, empty and blank texts have an empty set and are linked with nothing; equal
sets of any size are linked; a row without doc_id is kept with a null component and links nothing;
rows that repeat a doc_id each follow their own text, but classes headed by one id count as one
document; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from talus.llm.buffers import U64, mix, shingle_sets, slices
from talus.llm.components import fewer, merged
from talus.session import cut, in_python, written

BANDS, ROWS, BATCH = 40, 6, 20
HASHES = BANDS * ROWS
_SEEDS = np.random.default_rng(77).integers(0, 1 << 32, (2, HASHES), dtype=np.uint32)
_MULTIPLY, _ADD = _SEEDS[0] | np.uint32(1), _SEEDS[1]
_BAND_WEIGHTS = mix(np.arange(1, ROWS + 1, dtype=U64)) | U64(1)
_BAND_IDS = mix(np.arange(1000, 1000 + BANDS, dtype=U64))


def signature(items: np.ndarray) -> np.ndarray:
    """HASHES minima of 32-bit hashes; blocks keep the product table in cache."""
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    short = (items >> U64(32)).astype(np.uint32)
    for lo in range(0, len(short), 256):
        values = short[lo : lo + 256, None] * _MULTIPLY
        values += _ADD
        np.minimum(best, values.min(axis=0), out=best)
    return best


def bands(sig: np.ndarray) -> np.ndarray:
    return mix((sig.astype(U64).reshape(BANDS, ROWS) * _BAND_WEIGHTS).sum(axis=1, dtype=U64) + _BAND_IDS).view(np.int64)


def set_key(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def least_matches(threshold: float, miss: float) -> np.ndarray:
    """By number of compared signature values, the fewest matches that keep a pair.

    Under a uniform prior the posterior of the similarity after m matches of n is Beta(m+1, n-m+1);
    its chance to reach the threshold is a binomial sum over n+1 draws. Only the low byte of each
    value is compared; its chance matches can keep a pair, never drop one.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total = 0.0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
        out.append(m)
    return np.array(out)


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text"), size)
            sigs = [signature(x) if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([set_key(x) if len(x) else None for x in sets], pa.binary()),
                    pa.array([None if x is None else x.astype(np.uint8).tobytes() for x in sigs], pa.binary()),
                    pa.array([None if x is None else bands(x) for x in sigs], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "set_key", "sig", "bands"],
            )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text"), size)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([set_key(x) if len(x) else None for x in sets], pa.binary()),
                    pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())),
                ],
                ["rep", "set_key", "items"],
            )

    return run


def _plausible(threshold: float, miss: float):
    least = least_matches(threshold, miss)

    @pandas_udf("boolean")
    def plausible(a, b):
        left = np.frombuffer(b"".join(a), np.uint8).reshape(len(a), HASHES)
        right = np.frombuffer(b"".join(b), np.uint8).reshape(len(b), HASHES)
        alive = np.arange(len(a))
        matches = np.zeros(len(a), int)
        for k, need in enumerate(least):
            part = slice(k * BATCH, (k + 1) * BATCH)
            matches[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
            alive = alive[matches[alive] >= need]
        out = np.zeros(len(a), bool)
        out[alive] = True
        return pd.Series(out)

    return plausible


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80, miss: float = 1e-8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Two documents are linked when 100 * |A and B| >= percent * |A or B| over their distinct shingles
    of ``size`` words; component_id is the smallest doc_id reachable over links.
    A link at the threshold escapes all bands with chance (1 - 0.8**6)**40, about 5 in a million;
    one of similarity 0.85 in a billion.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = written(
        in_python(docs, _sketch(size), "doc_id long, n_shingles long, set_key binary, sig binary, bands array<long>"), "sketch"
    )
    classes = written(
        sketch.where("set_key is not null and doc_id is not null")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")),
        "classes",
    )
    members = classes.select("rep", "n", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("band")
    left = written(members.join(shared, "band").select("band", "rep", "n", F.lit(1).alias("place"), F.col("rep").alias("component")).distinct(), "members")
    sets = _full_sets(docs, classes, left.select("rep").distinct(), size)
    sigs = classes.select("rep", "sig")
    plausible = _plausible(percent / 100, miss)
    labels = done = None
    centres = 1
    while rows := left.count():
        left = fewer(left, rows)
        first, others, rest = _centres(left, centres)
        # both sets ordered by rarity, this their first item in common: no more than what follows can be
        most = "(1 + least(n - place, v_n - v_place))"
        pairs = others.join(first, "band").where(f"rep > v and component <> v_component and 100 * {most} >= {percent} * (n + v_n - {most})")
        pairs = fewer(pairs.select(F.col("rep").alias("u"), "v"), rows).distinct()
        pairs = cut(pairs if done is None else pairs.join(done, ["u", "v"], "left_anti"))
        pairs = fewer(pairs, pairs.count())
        done = pairs if done is None else done.union(pairs)
        likely = cut(
            pairs.join(sigs.select(F.col("rep").alias("u"), F.col("sig").alias("su")), "u")
            .join(sigs.select(F.col("rep").alias("v"), F.col("sig").alias("sv")), "v")
            .where(plausible("su", "sv"))
            .select("u", "v")
        )
        if not likely.isEmpty():
            labels = merged(labels, _confirmed(sets, likely, percent))
        left = _unsettled(rest, labels)
        if done is pairs:
            left = _unsettled(_by_rare_items(left, sets, percent), labels)
        else:
            centres *= 32
    if labels is None:
        labels = docs.sparkSession.createDataFrame([], "id long, component long")
    keyed = classes.join(labels, classes.rep == labels.id, "left").select(
        "set_key", F.coalesce("component", "rep").alias("component_id")
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return (
        sketch.select("doc_id", "n_shingles", "set_key")
        .join(keyed, "set_key", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _centres(left: DataFrame, count: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ``count`` smallest members of each bucket, those they are compared with, and those left after."""
    centre = [F.col("rep").alias("v"), F.col("n").alias("v_n"), F.col("place").alias("v_place"), F.col("component").alias("v_component")]
    if count == 1:
        low = left.groupBy("band").agg(F.min(F.struct("rep", "n", "place", "component")).alias("c")).select("band", "c.*")
        rest = left.join(low.select("band", F.col("rep").alias("low")), "band").where("rep > low").drop("low")
        return low.select("band", *centre), rest, rest
    ranked = cut(left.withColumn("rank", F.row_number().over(Window.partitionBy("band").orderBy("rep"))))
    return ranked.where(F.col("rank") <= count).select("band", *centre), ranked.where(F.col("rank") > 1), ranked.where(F.col("rank") > count)


def _unsettled(left: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of the buckets that still hold several components."""
    left = left.select("band", "rep", "n", "place")
    if labels is None:
        left = left.withColumn("component", F.col("rep"))
    else:
        left = left.join(labels, left.rep == labels.id, "left").select("band", "rep", "n", "place", F.coalesce("component", "rep").alias("component"))
    mixed = left.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    left = cut(left.join(mixed.select("band"), "band"))
    return fewer(left, left.count())


def _by_rare_items(left: DataFrame, sets: DataFrame, percent: int, salts: int = 8) -> DataFrame:
    """The members of ``left`` in one bucket for each rare item that a link may have to share.

    Counts come from a map-side combined aggregation and are joined back salted, as one item may be
    in very many sets.
    """
    salt = F.pmod(F.col("rep"), F.lit(salts)).cast("int")
    items = sets.join(left.select("rep", "n").distinct(), "rep").select("rep", "n", F.explode("items").alias("item"), salt.alias("salt"))
    shared = items.groupBy("item").agg(F.count("*").alias("holders")).where("holders > 1")
    shared = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    place = F.row_number().over(Window.partitionBy("rep").orderBy(F.coalesce("holders", F.lit(1)), "item"))
    ranked = items.join(shared, ["item", "salt"], "left").withColumn("place", place)
    prefix = ranked.where(F.expr(f"place <= n - ({percent} * n + 99) div 100 + 1 and holders > 1"))
    return prefix.select(F.col("item").alias("band"), "rep", "n", "place")


def _full_sets(docs: DataFrame, classes: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """rep, items: the whole set of each class in ``reps``."""
    heads = classes.join(reps, "rep").select("set_key", "rep")
    texts = docs.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    sets = in_python(texts, _sets(size), "rep long, set_key binary, items array<long>").join(heads, ["rep", "set_key"], "left_semi")
    return written(sets.dropDuplicates(["rep", "set_key"]).select("rep", "items"), "sets", "lz4")


def _confirmed(sets: DataFrame, likely: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    both = likely.join(sets.select(F.col("rep").alias("u"), F.col("items").alias("a")), "u").join(
        sets.select(F.col("rep").alias("v"), F.col("items").alias("b")), "v"
    )
    shared = F.size(F.array_intersect("a", "b")).cast("long")
    both = both.select("u", "v", shared.alias("n"), (F.size("a") + F.size("b")).alias("total"))
    return cut(both.where(100 * F.col("n") >= percent * (F.col("total") - F.col("n"))).select("u", "v"))
