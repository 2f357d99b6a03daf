"""Package names: confusable pairs, nearest known names, phantoms, version ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def adjacent_swap(a: Column, b: Column) -> Column:
    """Whether two strings of equal length differ by one swap of neighbours."""
    n = F.char_length(a)
    at = lambda s, i: F.substr(s, i, F.lit(1))
    apart = F.filter(F.sequence(F.lit(1), n), lambda i: at(a, i) != at(b, i))
    i, j = F.get(apart, F.lit(0)), F.get(apart, F.lit(1))
    swapped = (F.size(apart) == 2) & (j == i + 1) & (at(a, i) == at(b, j)) & (at(a, j) == at(b, i))
    return (n > 1) & (n == F.char_length(b)) & F.coalesce(swapped, F.lit(False))


def bare(name: Column) -> Column:
    return F.regexp_replace(name, "[-_.]", "")


def variants(name: Column, deletions: int) -> Column:
    """Hashes of a name and of all that is left of it after up to so many deletions of a character."""
    out = F.array(name)
    for _ in range(deletions):
        shorter = lambda x: F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(x))), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1))
        )
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, shorter))))
    return F.transform(out, lambda x: F.xxhash64(x))


def _near(names: DataFrame, corpus: DataFrame, deletions: int) -> DataFrame:
    """Distinct pairs name, known that share a variant: all pairs within so many edits, and neighbours swapped.

    An equi-join on variants; a name has as many of them as its length allows, however many names there are.
    """
    each = lambda df, c: df.select(c, F.explode(variants(F.col(c), deletions)).alias("variant"))
    return each(names.select("name").distinct(), "name").join(each(corpus, "known"), "variant").where("name <> known").select("name", "known").distinct()


def confusables(names: DataFrame, corpus: DataFrame) -> DataFrame:
    """name, known, kind of the pairs one edit, one swap or only separators apart."""
    known = corpus.select(F.col("name").alias("known")).distinct()
    plain = names.select("name").distinct().withColumn("bare", bare(F.col("name")))
    apart = plain.join(known.withColumn("bare", bare(F.col("known"))), "bare").where("name <> known").select("name", "known")
    kind = (
        F.when(F.levenshtein("name", "known") == 1, "edit")
        .when(adjacent_swap(F.col("name"), F.col("known")), "swap")
        .when(bare(F.col("name")) == bare(F.col("known")), "separator")
    )
    return _near(names, known, 1).union(apart).distinct().withColumn("kind", kind).where("kind is not null")


def nearest_known(names: DataFrame, corpus: DataFrame, most: int = 2) -> DataFrame:
    """name, known, distance: the closest corpus name within ``most`` edits; of equals the first by ``place`` (where the corpus has it), then name."""
    place = F.min("place") if "place" in corpus.columns else F.lit(0)
    known = corpus.groupBy(F.col("name").alias("known")).agg(place.alias("place"))
    pairs = _near(names, known.select("known"), most).withColumn("distance", F.levenshtein("name", "known", most)).where("distance >= 0")
    best = F.min(F.struct("distance", "place", "known")).alias("best")
    return pairs.join(known, "known").groupBy("name").agg(best).select("name", "best.known", F.col("best.distance").cast("long").alias("distance"))


def in_range(rows: DataFrame, incidents: DataFrame) -> DataFrame:
    """Rows (name, version) that an incident (name, lo, hi, ref) covers; null bounds are open."""
    inside = (F.col("lo").isNull() | (F.col("version") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("version") <= F.col("hi")))
    return rows.join(incidents, "name").where(inside)


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("turn", turn).where("turn = 1").drop("turn")
