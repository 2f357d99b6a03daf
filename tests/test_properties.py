import math
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talus.functions.text import byte_entropy, pattern_hits
from talus.operators.correlate import consensus, escalated
from talus.operators.graph import closure, depths
from talus.operators.history import anomalies, streaks, versions
from talus.operators.names import adjacent_swap, confusables, nearest_known
from talus.operators.scoring import package_scores
from talus.sources.calls import CallFacts, masked


def finds(seed, n=300):
    r = random.Random(seed)
    rows = [(f"d{r.randrange(9)}", f"f{r.randrange(4)}", r.choice("abc"), r.choice(["info", "warning", "critical"]), r.random() < 0.5, r.randrange(5)) for _ in range(n)]
    return rows, "dep string, file_path string, category string, severity string, compile_time boolean, evidence int"


def test_scores_stay_in_range_and_grow_with_findings(spark):
    rows, schema = finds(1)
    some = {r.dep: r.risk_score for r in package_scores(spark.createDataFrame(rows[:150], schema)).collect()}
    more = {r.dep: r.risk_score for r in package_scores(spark.createDataFrame(rows, schema)).collect()}
    assert all(0 <= s <= 100 for s in more.values()) and all(more[d] >= s for d, s in some.items())


def test_correlation_never_lowers_a_severity(spark):
    rank = {"info": 0, "warning": 1, "critical": 2}
    rows, schema = finds(2)
    frame = spark.createDataFrame(rows, schema).withColumn("id", F.monotonically_increasing_id()).cache()
    before = {r.id: rank[r.severity] for r in frame.collect()}
    assert all(rank[r.severity] >= before[r.id] for r in escalated(frame, "a", "b").collect())


def swapped(a, b):
    d = [i for i in range(len(a)) if len(a) == len(b) and a[i] != b[i]]
    return len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]


def test_swaps_and_nearest_names(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abc-_") for _ in range(r.randint(1, 5))) for _ in range(60)]
    pairs = spark.createDataFrame([(a, b) for a in words[:30] for b in words[30:]], "a string, b string")
    assert all(x.s == swapped(x.a, x.b) for x in pairs.select("a", "b", adjacent_swap(F.col("a"), F.col("b")).alias("s")).collect())
    names, corpus = (spark.createDataFrame([(w,) for w in x], "name string") for x in (words[:30], words[30:]))
    near = {x.name: (x.known, x.distance) for x in nearest_known(names, corpus).collect()}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row, old = [i], row
            for j, d in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != d)))
        return row[-1]

    for w in set(words[:30]):
        best = min(((lev(w, k), k) for k in set(words[30:]) if k != w), default=(9, ""))
        assert near.get(w) == ((best[1], best[0]) if best[0] <= 2 else None)
    assert all(x.name != x.known for x in confusables(names, corpus).collect())


def test_graphs_with_cycles_and_unreachable_nodes(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdez"], "node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e")], "src string, dst string")
    direct = nodes.where("node in ('a', 'e')")
    assert {r.node: r.depth for r in depths(nodes, edges, direct).collect()} == {"a": 1, "b": 2, "c": 3, "d": 4, "e": 1, "z": 1}
    assert {(r.root, r.node) for r in closure(direct, edges).collect()} == {("a", "b"), ("a", "c"), ("a", "d")}


def test_history_cases(spark):
    scans = spark.createDataFrame(
        [("p", "1", "2024-01-01", 0, []), ("p", "2", "2024-01-02", 12, ["x"]), ("p", "3", "2024-01-03", 0, []), ("p", "4", "2024-01-04", 1, ["x", "y"])],
        "package string, version string, scan_date string, finding_count int, categories array<string>",
    )
    got = {r.version: (r.anomaly, r.severity) for r in anomalies(scans).collect()}
    assert got == {"2": (45, "critical"), "3": (0, "none"), "4": (25, "warning")}
    assert streaks(scans.where("version < '4'")).first().clean_streak == 1
    releases = spark.createDataFrame([("p", i, i) for i in range(1, 4)], "package string, version int, released int")
    assert {r.version: (r.previous, r.lookback) for r in versions(releases, 2).collect()} == {3: (2, 1), 2: (1, 1), 1: (None, 1)}


def test_consensus_counts_null_and_breaks_ties_by_hash(spark):
    votes = spark.createDataFrame([("p", "b"), ("p", "a"), ("q", None), ("q", None), ("q", "z")], "package string, findings_hash string")
    got = {r.package: (r.findings_hash, round(r.agreement, 3), r.total) for r in consensus(votes).collect()}
    assert got == {"p": ("a", 0.5, 2), "q": (None, 0.667, 3)}


def test_entropy_and_line_patterns(spark):
    texts = ["", "aaaa", "ab" * 9, "é😀x", "".join(map(chr, range(128)))]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.entropy for r in byte_entropy(frame, "k", "t").collect()}
    for k, t in enumerate(texts):
        b = t.encode()
        if b:
            assert abs(got[k] + sum(n / len(b) * math.log2(n / len(b)) for n in Counter(b).values())) < 1e-5
    hits = pattern_hits(spark.createDataFrame([(1, "http://x"), (2, "none")], "k int, line string"), [("h", "^http"), ("x", "x$")])
    assert sorted((r.k, r.pattern) for r in hits.collect()) == [(1, "h"), (1, "x")]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='abA.:("#\\\n{}) def', max_size=80))
def test_the_tokenizer_accepts_any_text(content):
    assert len(masked(content)) == len(content) and masked(content).count("\n") == content.count("\n")
    list(CallFacts.func().eval(content))
