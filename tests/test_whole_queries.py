import random

import __spark_entry__
import duckdb

from talus.operators import compare
from talus.operators.graph import closure_by_doubling, depths

DATA = "/root/testdata/sf0.001"


def oracle(name, tables):
    held = duckdb.connect()
    for t in tables:
        held.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return sorted(map(tuple, held.execute(__spark_entry__.oracle_sql()[name]).fetchall()))


def rows(spark, name):
    return sorted(map(tuple, __spark_entry__.queries()[name](spark, DATA).collect()))


def test_each_capability_problem_occurs(spark):
    frame = lambda x: spark.createDataFrame(x, "k long, capability string")
    said = frame([(1, "a"), (1, "b"), (1, "zz"), (3, "a"), (3, "a")])
    used = frame([(1, "a"), (1, "c"), (2, "a"), (3, "b")])
    got = compare.capability_problems(said, used, frame([(0, x) for x in "abc"]), "k")
    want = [(1, "b", "declared_unused"), (1, "c", "undeclared_use"), (1, "zz", "unknown"), (3, "a", "declared_unused"), (3, "b", "undeclared_use")]
    assert sorted(map(tuple, got.collect())) == want


def test_capabilities_of_every_supplier(spark):
    got = rows(spark, "capability_mismatch_whole")
    assert got == oracle("capability_mismatch_whole", ["lineitem", "orders"])
    assert {p for _, _, p in got} == {"undeclared_use", "declared_unused", "unknown"}
    assert {s for s, _, _ in got} == set(range(min(s for s, _, _ in got), max(s for s, _, _ in got) + 1)) and len({s for s, _, _ in got}) == 10


def test_names_graph_and_files_are_whole(spark):
    tables = ["part", "documents"]
    got = {n: rows(spark, n) for n in ("typosquat_pairs_whole", "nearest_known_whole", "patch_suggestions_whole", "transitive_closure_whole", "file_set_diff_whole", "manifest_hash_verify_whole")}
    assert all(x == oracle(n, tables) for n, x in got.items())
    held = duckdb.sql(f"SELECT count(*) FROM '{DATA}/documents.parquet' WHERE source IN ('src0', 'src1') GROUP BY source").fetchall()
    assert len(got["file_set_diff_whole"]) == max(n for n, in held)
    pairs = {(a, b) for a, b, _ in got["typosquat_pairs_whole"]}
    assert pairs == {(b, a) for a, b in pairs}
    # every part is a root that reaches something
    nodes = duckdb.sql(f"SELECT count(*) FROM '{DATA}/part.parquet'").fetchall()[0][0]
    assert len({r for r, _ in got["transitive_closure_whole"]}) == nodes


def test_many_hops_a_round_and_doubling(spark):
    r = random.Random(6)
    pairs = [(i, i + 1) for i in range(21)] + [(r.randrange(40), r.randrange(40)) for _ in range(25)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    nodes = spark.range(45).withColumnRenamed("id", "node")
    direct = nodes.where("node in (0, 30)")
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)

    def walk(starts):
        found, new, depth = dict.fromkeys(starts, 1), set(starts), 1
        while new:
            depth += 1
            new = {b for a in new for b in after.get(a, ()) if b not in found}
            found |= dict.fromkeys(new, depth)
        return found

    reached = walk([0, 30])
    assert {x.node: x.depth for x in depths(nodes, edges, direct, hops=3).collect()} == {i: reached.get(i, 1) for i in range(45)}
    want = {(i, j) for i in range(45) for j in walk([i]) if i != j}
    assert {tuple(x) for x in closure_by_doubling(nodes, edges).collect()} == want


def test_capability_pairs_meet_in_one_aggregate_and_many_rows_get_more_tasks(spark, monkeypatch):
    found = __spark_entry__.queries()["capability_mismatch_whole"](spark, DATA)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan and plan.count("Join LeftOuter") == 2
    monkeypatch.setattr("talus.session.TASK_ROWS", 1000)
    dealt = rows(spark, "capability_mismatch_whole")
    assert dealt == oracle("capability_mismatch_whole", ["lineitem", "orders"])
    plan = __spark_entry__.queries()["capability_mismatch_whole"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    items = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert f", {-(-2 * items // 1000)}" in plan
