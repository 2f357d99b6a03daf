import hashlib
import json
import random
import __spark_entry__
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from talus.functions import documents
from talus.operators import cache
from talus.operators.profiles import prior_versions

SCHEMA = "package string, version string, module string, imports array<struct<m:string,f:string,a:int>>, exports array<struct<f:string,a:int>>, atoms array<string>, dispatch int"


def rows(spark, *found):
    return spark.createDataFrame([(p, v, m, [("os", "cmd", 1)], [], [], d) for p, v, m, d in found], SCHEMA)


def files(root):
    return {str(p): (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(root).rglob("*.parquet")}


def test_saving_one_version_leaves_the_others_alone(spark, tmp_path):
    root = str(tmp_path / "store")
    cache.save(rows(spark, ("a", "1.9.0", "M", 1), ("a", "1.9.0", "N", 1), ("a", "1.10.0", "M", 2), ("b", "1.0.0", "M", 3)), root)
    before = files(root)
    cache.save(rows(spark, ("a", "1.10.0", "M", 9)), root)
    after = files(root)
    same = lambda held: {p: x for p, x in held.items() if "1.10.0" not in p}
    assert same(before) == same(after) and before != after
    assert [r.dispatch for r in cache.load(spark, root, "a", "1.10.0").collect()] == [9]
    plan = cache.load(spark, root, "a", "1.9.0")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(package" in plan and "(version" in plan.split("PartitionFilters")[1][:200]
    assert [tuple(r) for r in cache.versions(spark, root).collect()] == [("a", "1.10.0"), ("a", "1.9.0"), ("b", "1.0.0")]
    assert cache.drop(spark, root, "a", "1.9.0") and not cache.drop(spark, root, "a", "1.9.0")
    assert cache.load(spark, root, "a", "1.9.0").count() == 0 and cache.load(spark, root, "b", "1.0.0").count() == 1
    assert {(r.package, r.version) for r in cache.manifest(spark, root).collect()} == {("a", "1.10.0"), ("b", "1.0.0")}


def test_prior_versions_of_the_store_go_by_text(spark, tmp_path):
    root = str(tmp_path / "store")
    cache.save(rows(spark, ("a", "1.9.0", "M", 1), ("a", "1.10.0", "M", 2), ("a", "2.0.0", "M", 2)), root, salts=3)
    cached = cache.versions(spark, root, "a").withColumnRenamed("package", "dep")
    assert prior_versions(cached, spark.createDataFrame([("a", "2.0.0")], "dep string, version string")).first().prior == "1.9.0"
    with pytest.raises(FileNotFoundError):
        cache.stored(spark, str(tmp_path / "nowhere"))


def test_digests_tell_profiles_apart(spark, tmp_path):
    root = str(tmp_path / "store")
    cache.save(rows(spark, ("a", "1", "M", 1), ("b", "1", "M", 1), ("c", "1", "M", 2), ("d=/%", "1", "N", 1)), root)
    got = {r.package: r.digest for r in cache.manifest(spark, root).collect()}
    assert got["a"] == got["b"] and len(set(got.values())) == 3 and cache.load(spark, root, "d=/%", "1").count() == 1


def shuffled(value, r):
    if isinstance(value, dict):
        keys = list(value)
        r.shuffle(keys)
        return {k: shuffled(value[k], r) for k in keys}
    return [shuffled(v, r) for v in value] if isinstance(value, list) else value


def test_equal_documents_give_one_digest_in_any_order_of_keys(spark):
    doc = {"b": [1, {"z": None, "a": "é\n"}, []], "a": {"y": {"k": True, "c": 2}, "x": "s"}, "": 0}
    r = random.Random(1)
    texts = [json.dumps(shuffled(doc, r), indent=r.choice([None, 1, 3]), ensure_ascii=r.random() < 0.5) for _ in range(30)]
    want = json.dumps(doc, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(documents.canonical(F.col("t")).alias("c"), documents.digest(F.col("t")).alias("d")).distinct().collect()
    assert [(r.c, r.d) for r in got] == [(want, hashlib.sha256(want.encode()).hexdigest())]


def test_manifests_read_back_and_bad_ones_are_null(spark):
    good = {"package": "p", "version": "1", "module_hashes": [{"module": "M", "content_hash": "h", "more": 1}], "capabilities": ["ssh", "dns"], "signer": None, "notes": "n", "x": 1}
    texts = {"good": json.dumps(good), "bare": "{}", "list": "[1]", "cut": '{"package":', "twice": '{"a":1,"a":2}', "hash": '{"module_hashes":[{"module":"M"}]}', "null": None, "number": "3"}
    df = spark.createDataFrame(list(texts.items()), "k string, t string").withColumn("m", documents.manifest(F.col("t")))
    got = {r.k: (r.m, r.w, r.again) for r in df.select("k", "m", documents.written(F.col("m")).alias("w"), documents.manifest(documents.written(F.col("m"))).alias("again")).collect()}
    assert {k for k, x in got.items() if x[0] is not None} == {"good", "bare"}
    m, text, again = got["good"]
    assert (m.package, m.capabilities, [tuple(h) for h in m.module_hashes]) == ("p", ["ssh", "dns"], [("M", "h")])
    assert text == '{"capabilities":["dns","ssh"],"module_hashes":[{"content_hash":"h","module":"M"}],"notes":"n","package":"p","signed_at":null,"signer":null,"version":"1"}'
    assert again.module_hashes == m.module_hashes and again.capabilities == ["dns", "ssh"] and got["bare"][0].module_hashes == []


def test_manifests_parse_each_text_once_and_equal_the_expression(spark):
    texts = [' \t\r\n{"package":"p","module_hashes":[{"module":"M","content_hash":"h"}],"capabilities":["b",1,"a"]}', '{"module_hashes":[{"module":"M"}]}', '{"package":', '"{"', "[{}]", "{}", "1", "null", "", None, "{} x"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = documents.manifests(df, "t", "m").select("k", "m").collect()
    assert sorted(got, key=lambda r: r.k) == sorted(df.select("k", documents.manifest(F.col("t")).alias("m")).collect(), key=lambda r: r.k)
    kind = F.try_parse_json("t").isNotNull() & F.schema_of_variant(F.try_parse_json("t")).startswith("OBJECT")
    assert {r.k for r in got if r.m} == {r.k for r in df.where(kind).collect()} - {1}
    found = __spark_entry__.queries()["manifest_documents"](spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 2
