"""Line dedup over the whole corpus by a deletion-neighbourhood join.

DataFrame functions only. A line of at least ``least`` characters goes when an earlier line, by
(doc_id, line number), equals it or is one edit away: a character more, fewer or other. The earliest
stays, so every removed line has an earlier neighbour. Lines of ``exact`` to ``least`` characters go
when an earlier line equals them.

Equal lines are first reduced to one. A line and its neighbour agree in one of two halves, and in
one half of what is left, so the lines that share no such part with another are done. For the others
the variants with one character deleted from the remaining part are emitted as hashed keys together
with the shared parts, and equal variants meet: at the same place in lines of one length (another
character), or as a whole line and a variant of a longer one. A group of equal variants is compared
with its earliest line alone, which decides for all of it, and the pair is verified by edit distance.

Defined cases: a null text has no lines and stays null; blank lines and those below both lengths stay; rows that
repeat both doc_id and text count as one document and get the same result; a null doc_id is later
than all others; other columns are kept in ``row``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.session import forget, written

LEAST = 20
#: Per-document tables of up to so many bytes are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
_SALTS = 16
_PATHS = ("pp", "ps", "sp", "ss")


def small(df: DataFrame, each: Column) -> DataFrame:
    """Broadcast ``df`` if its rows of ``each`` bytes are few enough together, else leave the join to a shuffle."""
    return F.broadcast(df) if (df.agg(F.sum(each)).first()[0] or 0) <= BROADCAST_BYTES else df


def _parts(length: Column, base: Column, path: str) -> tuple[Column, Column]:
    """Characters taken from the left and from the right when halving ``base`` along ``path``."""
    left, right, rest = F.lit(0), F.lit(0), base
    for turn in path:
        half = F.floor(rest / 2).cast("int")
        if turn == "p":
            left, rest = left + half, rest - half
        else:
            right, rest = right + (rest - half), half
    return left, right


def _part_key(line: Column, length: Column, base: Column, path: str) -> Column:
    left, right = _parts(length, base, path)
    return F.xxhash64(base, F.lit(path), F.left(line, left), F.right(line, right))


def _lines(docs: DataFrame, least: int, exact: int) -> DataFrame:
    """key columns of each document and (at, line) of its lines that take part."""
    parts = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    takes = lambda x: (F.char_length(x) >= least) & (F.trim(x) != "")
    if exact < least:
        takes = lambda x: (F.char_length(x) >= exact) & F.when(F.char_length(x) >= least, F.trim(x) != "").otherwise(x.rlike(r"\S"))
    long = F.filter(parts, lambda s: takes(s["line"]))
    return docs.select("doc", "text_key", F.inline(long))


def _indexed(docs: DataFrame, least: int, exact: int) -> DataFrame:
    """doc, text_key, at, a, b (the line's two hashes), and its four half keys, null below ``least``."""
    line = F.col("line")
    held = _lines(docs, least, exact).withColumn("n", F.char_length("line"))
    keys = [_part_key(line, F.col("n"), base, path) for base in (F.col("n"), F.col("n") - 1) for path in "ps"]
    return held.select("doc", "text_key", "at", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), F.when(F.col("n") >= least, F.array(*keys)).alias("halves"))


def _sharing(rows: DataFrame, keys: str, by: list[str]) -> DataFrame:
    """The (``by``, key) rows of ``rows`` whose key another line holds too."""
    each = rows.select(*by, F.explode(F.array_distinct(keys)).alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("holders")).where("holders > 1").select("key")
    return each.join(shared, "key", "left_semi")


def _neighbours(lines: DataFrame) -> DataFrame:
    """(a, b) of the lines (a, b, first, line) that have an earlier line one edit away."""
    line, n = F.col("line"), F.char_length("line")
    bases = [(n, "own"), (n - 1, "less")]
    forms = F.array(
        *[
            F.struct(
                _part_key(line, n, base, path).alias("key"),
                F.lit(kind).alias("kind"),
                F.substr(line, _parts(n, base, path)[0] + 1, n - _parts(n, base, path)[0] - _parts(n, base, path)[1]).alias("rest"),
            )
            for base, kind in bases
            for path in _PATHS
        ]
    )
    formed = lines.select("a", "b", "first", F.inline(forms))
    shared = formed.select("a", "b", "key").distinct().groupBy("key").agg(F.count("*").alias("holders")).where("holders > 1").select("key")
    # each part below reads this table, so that no plan holds the forms several times
    formed = written(formed.join(shared, "key", "left_semi"), "forms", "lz4")
    rest, size = F.col("rest"), F.char_length("rest")
    variants = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(i.alias("place"), F.concat(F.substr(rest, F.lit(1), i - 1), F.substr(rest, i + 1)).alias("variant")))
    whole = formed.where("kind = 'own'").select("a", "b", "first", F.xxhash64("key", "rest").alias("hash"))
    deleted = formed.where(size > 0).select("a", "b", "first", "key", "kind", F.inline(variants))
    same_place = deleted.where("kind = 'own'").select("a", "b", "first", F.xxhash64("key", "place", "variant").alias("hash"))
    longer = deleted.where("kind = 'less'").select("a", "b", "first", F.xxhash64("key", "variant").alias("hash")).distinct()
    earliest = F.min(F.struct("first", "a", "b")).alias("lead")
    lead = same_place.groupBy("hash").agg(earliest, F.count("*").alias("holders")).where("holders > 1").select("hash", "lead")
    of_whole = whole.select("hash", F.struct("first", "a", "b").alias("lead"))
    other_length = longer.join(of_whole, "hash").select("a", "b", "first", "lead")
    other_length = other_length.union(whole.join(longer.groupBy("hash").agg(earliest), "hash").select("a", "b", "first", "lead"))
    later = [x.where("lead.first < first").select("a", "b", F.col("lead.a").alias("la"), F.col("lead.b").alias("lb")) for x in (same_place.join(lead, "hash"), other_length)]
    pairs = written(later[0], "pairs").union(written(later[1], "pairs")).distinct()
    forget(lines.sparkSession, formed)
    texts = lines.select("a", "b", "line")
    other = lines.select(F.col("a").alias("la"), F.col("b").alias("lb"), F.col("line").alias("earlier"))
    near = F.levenshtein("line", "earlier", 1)
    return pairs.join(texts, ["a", "b"]).join(other, ["la", "lb"]).where(near.between(0, 1)).select("a", "b").distinct()


def removed_lines(docs: DataFrame, least: int = LEAST, exact: int | None = None) -> DataFrame:
    """doc, text_key, gone (numbers of the removed lines) for each document that loses any."""
    lines = written(_indexed(docs, least, least if exact is None else exact), "lines")
    first = F.struct("doc", "text_key", "at")
    kept = written(
        lines.groupBy("a", "b").agg(F.min(first).alias("first"), F.max(first).alias("last"), F.first("halves").alias("halves")), "distinct"
    )
    likely = _sharing(kept, "halves", ["a", "b", "first"]).select("a", "b", "first").distinct()
    places = likely.groupBy("first.doc", "first.text_key").agg(F.collect_list(F.struct("first.at", "a", "b", "first")).alias("wanted"))
    places = written(places, "places")
    found = docs.join(small(places, 48 + 64 * F.size("wanted")), ["doc", "text_key"])
    rows = F.split("text", "\n")
    texts = found.select(F.inline(F.transform("wanted", lambda w: F.struct(w["a"].alias("a"), w["b"].alias("b"), w["first"].alias("first"), F.get(rows, w["at"]).alias("line")))))
    texts = written(texts.dropDuplicates(["a", "b"]), "texts", "lz4")
    near = written(_neighbours(texts), "near").withColumn("near", F.lit(True))
    verdicts = kept.join(near, ["a", "b"], "left").where("near or first <> last").select("a", "b", "first", F.coalesce("near", F.lit(False)).alias("near"))
    verdicts = verdicts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salted = lines.select("doc", "text_key", "at", "a", "b", F.pmod(F.xxhash64("doc", "text_key"), F.lit(_SALTS)).cast("int").alias("salt"))
    gone = salted.join(verdicts, ["a", "b", "salt"]).where(F.col("near") | (F.struct("doc", "text_key", "at") > F.col("first")))
    return gone.groupBy("doc", "text_key").agg(F.collect_set("at").alias("gone"))


def dedup_lines(docs: DataFrame, least: int = LEAST, exact: int | None = None) -> DataFrame:
    """``row`` (all columns of ``docs``, its text without repeated lines), and the long n_lines and n_removed.

    Exact repeats go from ``exact`` characters on (``least`` if none is given), near ones from ``least`` on.
    """
    last = F.lit((1 << 63) - 1)
    text = F.col("text").cast("string")
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), last).alias("doc"),
        F.xxhash64(text).alias("text_key"),
        text.alias("text"),
    )
    base = keyed.select("doc", "text_key", "text").where("text is not null")
    gone = written(removed_lines(base, least, exact), "gone")
    rows = F.split("text", "\n")
    every = F.sequence(F.lit(0), F.size(rows) - 1)
    kept = F.array_join(F.transform(F.array_except(every, F.col("gone")), lambda i: F.get(rows, i)), "\n")
    joined = keyed.join(small(gone, 48 + 4 * F.size("gone")), ["doc", "text_key"], "left")
    return joined.select(
        F.when(F.col("gone").isNull(), F.col("row")).otherwise(F.col("row").withField("text", kept)).alias("row"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(rows)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )
