"""Personal data: base patterns as seeds, bootstrapped contextual patterns for the rest.

DataFrame functions only. Base matches (e-mail, ip, card, phone) are the seed entities, and so are
published forms of access keys and random-looking hexadecimal runs (kind secret; a key counts by itself,
a hexadecimal run only where a learned pattern surrounds it). Every token with a digit or an at sign, cut at
quotes, brackets and equals signs, is a candidate instance. Its lexical patterns are the one and the
two words before it with what is glued to it, the word behind it, and the words on both sides; earlier candidates
stand as a placeholder. On the graph of distinct (pattern, instance) pairs, confidence flows from
instances to patterns and back for a few rounds: a pattern's confidence in a kind is the smoothed share of its
distinct instances that hold it, an instance's that of its confident patterns together. Candidates that confident
patterns surround and that no base match touches are added under the pattern's kind.

Positions follow from splitting a text at the matches: a match starts after all earlier gaps and
matches, so sums over a document's own matches give code point offsets.

Defined cases: a null text is empty; matches that fail their check are dropped without a retry;
rows that repeat a doc_id are judged each by its own text; a null doc_id is kept; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.session import written

# Possessive and anchored forms of the base patterns: they find the same leftmost matches without
# trying every start of a long run again, and loops stay off the regex engine's stack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_CUT = r"\s=\"'`<>\[\]{}|,;"
CANDIDATE = rf"(?<![^{_CUT}])[^{_CUT}0-9@]*+[0-9@](?:[^{_CUT}]*[\p{{L}}0-9@])?"
#: Published forms of access keys: cloud key ids, forge tokens, signed web tokens.
KEY = r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)$"
HEX = r"^(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{16,}$"
KINDS = ("email", "ip", "card", "phone", "secret")
PLACEHOLDER = "#0"
_OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"[^0-9]"), F.lit(""))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).when(v > 4, v * 2 - 9).otherwise(v * 2))
    return (n > 0) & (F.aggregate(doubled, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0)


def passes(kind: Column, match: Column) -> Column:
    """The check of each base kind on its match."""
    d = _digits(match)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
        .when(kind == "card", F.length(d).between(12, 19) & luhn(d))
        .otherwise(F.length(d).between(9, 15))
    )


def _cut_at(text: Column, kind: str, pattern: str, needs: Column) -> Column:
    """Structs (kind, place, gap, tail, head, match) of a text's matches.

    ``gap`` is the length of the text before the match, ``tail`` its last words, ``head`` the first words
    of the text behind the match; only candidate tokens need words.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    words = kind == "token"
    spaced = lambda g: F.regexp_replace(g, r"\s+", " ")
    tail = (lambda g: F.substring_index(spaced(g), " ", -4)) if words else (lambda g: F.lit(""))
    head = (lambda g: F.substring_index(spaced(g), " ", 2)) if words else (lambda g: F.lit(""))
    behind = F.slice(F.transform(gaps, head), 2, F.size(found))
    cut = F.arrays_zip(
        F.slice(F.transform(gaps, F.length), 1, F.size(found)).alias("gap"),
        F.slice(F.transform(gaps, tail), 1, F.size(found)).alias("tail"),
        behind.alias("head"),
        found.alias("match"),
    )
    out = F.transform(
        cut,
        lambda c, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), c["gap"].alias("gap"), c["tail"].alias("tail"), c["head"].alias("head"), c["match"].alias("match")),
    )
    return F.when(needs & (F.size(found) > 0), out).otherwise(F.array().cast("array<struct<kind:string,place:int,gap:int,tail:string,head:string,match:string>>"))


def matches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, kind, start, end, left, right, match of all base matches and candidate tokens."""
    text = F.col("text")
    number = text.rlike("[0-9]")
    held = docs.where(text.rlike("[0-9@]")).select(
        "doc_id",
        "text_key",
        F.inline(
            F.concat(
                _cut_at(text, "email", EMAIL, text.contains("@")),
                _cut_at(text, "ip", IP, text.contains(".") & number),
                _cut_at(text, "card", CARD, number),
                _cut_at(text, "phone", PHONE, text.contains("+") & number),
                _cut_at(text, "token", CANDIDATE, F.lit(True)),
            )
        ),
    )
    # matches move, texts don't; rows that repeat a text count once
    held = held.repartition("doc_id", "text_key", "kind").dropDuplicates(["doc_id", "text_key", "kind", "place"])
    row = Window.partitionBy("doc_id", "text_key", "kind").orderBy("place")
    end = F.sum(F.col("gap") + F.length("match")).over(row.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = [F.coalesce(F.concat(F.lag("tail", n).over(row), F.lit(PLACEHOLDER)), F.lit("")) for n in (2, 1)]
    left = F.when(F.col("kind") == "token", F.concat(*before, "tail"))
    return held.select("*", end.cast("long").alias("end"), left.alias("left")).select(
        "doc_id", "text_key", "kind", (F.col("end") - F.length("match")).alias("start"), "end", "left", F.col("head").alias("right"), "match"
    )


def contexts(left: Column, right: Column) -> Column:
    """A candidate's patterns; digits count as 0, letters as small ones."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[0-9]", "0")
    left, right = plain(left), plain(F.trim(right))
    right = F.substring_index(F.when(right == "", PLACEHOLDER).otherwise(right), " ", 1)
    # the word before: the last one that holds a letter or stands for a candidate
    glued = F.substring_index(left, " ", -1).rlike(r"[\p{L}#]")
    one = F.when(glued, F.substring_index(left, " ", -1)).otherwise(F.substring_index(left, " ", -2))
    one = F.when(one.rlike(r"[\p{L}#]"), one).otherwise(F.substring_index(left, " ", -3))
    two = F.when(glued, F.substring_index(left, " ", -2)).otherwise(F.substring_index(left, " ", -3))
    worth = lambda c: c.rlike(r"\p{L}")
    named = [("one:", one, worth(one)), ("two:", two, worth(two)), ("behind:", right, worth(right)), ("both:", F.concat(one, F.lit(" _ "), right), worth(one) & worth(right))]
    return F.array_compact(F.array(*[F.when(good, F.concat(F.lit(kind), c)) for kind, c, good in named]))


def with_seeds(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(base spans, candidate tokens with their patterns and the kind of the first base span that touches them)."""
    base = found.where((F.col("kind") != "token") & passes(F.col("kind"), F.col("match")))
    tokens = found.where("kind = 'token'").select("doc_id", "text_key", "start", "end", "left", "right", "match")
    spans = base.groupBy(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_text")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("spans")
    )
    joined = tokens.join(spans, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_text")), "left")
    touching = F.filter("spans", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    base_kind = F.get(touching, F.lit(0))["kind"]
    key, random = F.col("match").rlike(KEY), F.col("match").rlike(HEX)
    return base, joined.select(
        "doc_id",
        "text_key",
        "start",
        "end",
        contexts(F.col("left"), F.col("right")).alias("patterns"),
        F.lower("match").alias("instance"),
        F.coalesce(base_kind, F.when(key | random, "secret")).alias("seed"),
        (base_kind.isNull() & key).alias("key"),
        base_kind.isNull().alias("free"),
    )


def bootstrap(tokens: DataFrame, rounds: int = 3, support: int = 3, confidence: float = 0.7, salts: int = 16) -> DataFrame:
    """doc_id, text_key, kind, start, end of the tokens that keys and confident patterns add.

    A pattern is confident in a kind with at least ``support`` distinct instances' worth of it and a smoothed
    share of ``confidence``. Rows are salted by pattern and instance together and the small side of each
    join is spread over the salts, so neither a frequent pattern nor a frequent instance meets in one task.
    """
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    salt = F.pmod(F.xxhash64("pattern", "instance"), F.lit(salts)).cast("int")
    usable = tokens.select("*", F.explode("patterns").alias("pattern")).drop("patterns")
    edges = written(usable.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")).withColumn("salt", salt), "edges")
    # the patterns that any seed touches enough; all others can't become confident in the first round
    sizes = written(edges.groupBy("pattern").agg(F.count("*").alias("n"), F.count("seed").alias("seeds")), "sizes")
    seeds = edges.where("seed is not null").select("pattern", "instance", F.col("seed").alias("kind"), F.lit(1.0).alias("held"))
    known, patterns = seeds, None
    for _ in range(rounds):
        scored = known.groupBy("pattern", "kind").agg(F.sum("held").alias("mass")).where(F.col("mass") >= support)
        scored = scored.join(sizes, "pattern").withColumn("trust", F.col("mass") / (F.col("n") + 1))
        patterns = written(scored.where(F.col("trust") >= confidence).select("pattern", "kind", "trust"), "patterns")
        if patterns.isEmpty():
            break
        reach = edges.where("seed is null").join(patterns.withColumn("salt", spread), ["pattern", "salt"])
        promoted = reach.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("trust"), F.lit(0.999)))))).alias("held"))
        again = edges.where("seed is null").join(promoted.withColumn("salt", spread), ["instance", "salt"]).select("pattern", "instance", "kind", "held")
        known = seeds.union(again)
    best = patterns.groupBy("pattern").agg(F.max(F.struct("trust", "kind")).alias("best"))
    enough = F.length(F.regexp_replace("instance", r"[^\p{L}0-9]", "")) >= 4
    fresh = usable.where(F.col("free") & ~F.col("key") & enough).withColumn("salt", salt)
    surrounded = fresh.join(best.withColumn("salt", spread), ["pattern", "salt"])
    named = surrounded.groupBy("doc_id", "text_key", "start", "end").agg(F.max("best").alias("best")).select("doc_id", "text_key", "best.kind", "start", "end")
    return named.union(tokens.where("key").select("doc_id", "text_key", F.lit("secret").alias("kind"), "start", "end"))


def find_pii(docs: DataFrame, **options) -> DataFrame:
    """doc_id, base and spans (arrays of (start, rank, end, kind), sorted) of every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    found = written(matches(docs), "matches")
    base, tokens = with_seeds(found)
    added = bootstrap(written(tokens, "tokens"), **options)
    kinds = F.array(*map(F.lit, KINDS))
    every = base.select("doc_id", "text_key", "kind", "start", "end", F.lit(True).alias("is_base")).union(
        added.select("doc_id", "text_key", "kind", "start", "end", F.lit(False).alias("is_base"))
    )
    span = F.struct("start", F.array_position(kinds, F.col("kind")).alias("rank"), "end", "kind")
    spans = every.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_base"), span))).alias("base"), F.array_sort(F.collect_set(span)).alias("spans")
    )
    rows = docs.select("doc_id", "text_key")
    joined = rows.join(spans, rows.doc_id.eqNullSafe(spans.doc_id) & (rows.text_key == spans.text_key), "left")
    none = F.array().cast("array<struct<start:bigint,rank:bigint,end:bigint,kind:string>>")
    return joined.select(rows.doc_id, F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
