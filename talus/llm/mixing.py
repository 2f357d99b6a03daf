"""Mixing sources to target weights along a time-varying curriculum.

Each source has a share of all words and a linear weight schedule over training time, whose
integral is that share. A source's documents follow a fixed pseudo-random order; the running sum of
their words is the demand at which each is due, and inverting the integrated schedule turns it into
a training position between 0 and 1. Documents are range-sorted by position.

Running sums are taken in two levels (square-root many hash buckets per source, then within the
bucket), so a source with a third of all rows never meets in one task.

Defined cases: a null or blank text has size 0, takes nothing and has no position; a null source is
a source of its own, ordered last; repeated rows are separate documents; documents without a doc_id
are spread over their source by their text; an empty table gives no rows; other columns are kept by
``mixed``, whatever their names, and ignored by ``mix_plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.session import cut, written

WORD = r"[^\x20\x09-\x0D]+"
CYCLE = 3
REPEATS = 3
#: Tilt of the weight schedule by a source's weight: early sources fall, late ones rise.
TILTS = (-0.5, 0.0, 0.5)
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def source_targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """key, source_size, weight, target, buckets for each source of ``sizes`` (source, size).

    Water filling: with sources by rising cap to weight ratio, the first level that leaves no
    uncapped source above its cap. The windows see one row a source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    weighed = totals.withColumn(
        "weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % CYCLE + 1
    ).withColumn("cap", F.col("source_size") * repeats)
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    below = ordered.rowsBetween(Window.unboundedPreceding, -1)
    levelled = weighed.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(below), F.lit(0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0))),
    )
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    # the level of the first source that fits holds for all from there on
    level = F.first(fits, ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    target = F.coalesce(level * F.col("weight"), F.col("cap").cast("double"))
    return levelled.select(
        _key(F.col("source")).alias("key"),
        "source_size",
        "weight",
        target.cast("double").alias("target"),
        F.ceil(F.sqrt("n_docs")).cast("long").alias("buckets"),
    )


def _with_sources(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Broadcast the source table only while it is small; else join it salted, against hot sources."""
    if sources.count() <= BROADCAST_SOURCES:
        return docs.join(F.broadcast(sources), "key")
    salts = 64
    spread = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return docs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(spread, ["key", "salt"]).drop("salt")


def demand_time(share: Column, tilt: Column) -> Column:
    """The time t at which the integral of 1 + tilt * (2t - 1) reaches ``share``."""
    curved = (F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * share) - (1 - tilt)) / (2 * tilt)
    # a falling schedule starts at minus zero
    return F.when(tilt == 0, share).otherwise(curved + F.lit(0.0))


def mix_plan(docs: DataFrame, repeats: int = REPEATS, tilts: tuple = TILTS) -> DataFrame:
    """doc_id, text_key, size, source_size, target, taken, weight, position, start, tilt for every row of ``docs``.

    Full passes over a source come first, then documents in order until its target is met; the last
    one is taken up to the word that meets it. ``position`` is the time of the first copy.
    """
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("text_key"))
    # words are counted once; all that follows reads this narrow table
    base = written(base, "sizes")
    sources = cut(source_targets(base.select("source", "size"), repeats))
    held = _with_sources(base.withColumn("key", _key(F.col("source"))), sources).withColumn(
        "order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("text_key").cast("string"))).cast("binary"))
    )
    point = F.conv(F.substring("order", 1, 8), 16, 10).cast("long")
    held = held.withColumn("bucket", (point * F.col("buckets") / F.lit(1 << 32)).cast("long"))
    sums = held.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("key", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("key", "bucket").orderBy("order", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums, ["key", "bucket"])
    start = F.col("before") + F.col("inside")
    goal = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    rest = goal - passes * F.col("source_size")
    part = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), rest - start))
    taken = (passes * F.col("size") + part).cast("long")
    tilt = F.element_at(F.array(*map(F.lit, tilts)), F.col("weight").cast("int"))
    return held.select(
        "doc_id", "text_key", "size", "source_size", "target", taken.alias("taken"), F.col("weight").cast("long").alias("weight"), "key", start.alias("start"), tilt.alias("tilt")
    ).select(
        "doc_id", "text_key", "size", "source_size", "target", "taken", "weight", "key",
        F.when(F.col("taken") > 0, demand_time(F.col("start") / F.col("target"), F.col("tilt"))).alias("position"),
        "start", "tilt",
    )


def by_position(plan: DataFrame) -> DataFrame:
    """Range-sorted by training position; the id parts those that are not taken."""
    return plan.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed(docs: DataFrame, repeats: int = REPEATS, tilts: tuple = TILTS) -> DataFrame:
    """The mix itself: a row of ``docs`` for every copy taken, range-sorted by training position.

    The copy that meets its source's target holds only its first words. Rows that repeat a doc_id
    are told apart by their text and source, so each keeps its own copies.
    """
    plan = mix_plan(docs, repeats, tilts).where("taken > 0").withColumn("whole", F.floor(F.col("taken") / F.col("size")).cast("int"))
    copies = F.when(F.col("taken") % F.col("size") > 0, F.col("whole") + 1).otherwise(F.col("whole")) - 1
    plan = plan.withColumn("copy", F.explode(F.sequence(F.lit(0), copies)))
    same = ["doc", "text_key", "source_key"]
    plan = plan.select(
        F.col("doc_id").alias("doc"),
        "text_key",
        F.col("key").alias("source_key"),
        "copy",
        "size",
        F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size")).alias("words"),
        demand_time((F.col("start") + F.col("copy") * F.col("source_size")) / F.col("target"), F.col("tilt")).alias("position"),
    )
    # rows repeated in full share their plan in order
    plan = plan.withColumn("turn", F.row_number().over(Window.partitionBy(*same, "copy").orderBy("position")))
    text = F.col("text").cast("string")
    named = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("doc"),
        F.xxhash64(text).alias("text_key"),
        _key(F.col("source").cast("string")).alias("source_key"),
    )
    named = named.withColumn("turn", F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0))))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) if c == "doc" else F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*same, "turn"]]
    out = named.alias("a").join(plan.alias("b"), on).select("row", "size", "words", "position", F.col("a.doc").alias("doc"), "copy")
    pieces = F.regexp_extract_all(F.col("row.text").cast("string"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    first = F.array_join(F.slice(pieces, 1, F.greatest(F.lit(1), F.col("words").cast("int"))), "")
    cut_short = F.col("words") < F.col("size")
    row = F.when(cut_short, F.col("row").withField("text", first)).otherwise(F.col("row"))
    if "n_chars" in docs.columns:
        row = F.when(cut_short, F.col("row").withField("text", first).withField("n_chars", F.char_length(first).cast("long"))).otherwise(F.col("row"))
    return out.select(row.alias("row"), "position", "doc", "copy").orderBy("position", "doc", "copy").select("row.*")
