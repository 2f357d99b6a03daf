import json
import time

import pytest

from talus.streaming import service

SCORES = [("a", 3, 95), ("b", 1, 30), ("c", 2, 29), ("d", 0, 50)]


def lines(n):
    out = []
    for i in range(n):
        e = {"package": "abcde"[i % 5], "version": f"1.{i % 3}.0", "seq": i}
        if i % 11 == 0:
            e["shift"] = ["low", "high", "critical"][i % 3]
        out.append(json.dumps(e))
    out[7], out[8], out[9], out[10] = "{", '{"version": "1"}', '{"package": "a", "version": ""}', "[1]"
    return out


def written(tmp_path, n=60, per_file=6):
    (tmp_path / "in").mkdir()
    every = lines(n)
    for k in range(0, n, per_file):
        (tmp_path / "in" / f"{k:04d}.json").write_text("\n".join(every[k : k + per_file]) + "\n")
    return every


def state(spark, out):
    return {name: sorted((tuple(x for c, x in sorted(r.asDict().items()) if c != "batch") for r in service.sink(spark, out, name).collect()), key=repr) for name in service.SINKS}


def twin(spark, every, scores):
    found = service.events(spark.createDataFrame([(x,) for x in every], "value string"))
    return {name: sorted((tuple(x for _, x in sorted(r.asDict().items())) for r in df.collect()), key=repr) for name, df in service.routes(found, scores).items()}


@pytest.fixture
def scores(spark):
    return spark.createDataFrame(SCORES, "dep string, finding_count long, risk_score long")


def test_sinks_equal_the_batch_twin_and_the_listener(spark, tmp_path, scores):
    every, out = written(tmp_path), str(tmp_path / "out")
    metrics = service.Metrics()
    spark.streams.addListener(metrics)
    try:
        q = service.start(spark, str(tmp_path / "in"), scores, out, str(tmp_path / "cp"), files_per_batch=3)
        q.awaitTermination(240)
        for _ in range(50):
            if metrics.batches >= 4:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(metrics)
    got = state(spark, out)
    assert got == twin(spark, every, scores)
    assert len(got["dead_letters"]) == 4
    assert metrics.batches == 4 and metrics.totals == {"lines": 60, "bad": len(got["dead_letters"])}
    assert {r.batch for r in service.sink(spark, out, "package_scans").select("batch").distinct().collect()} == {0, 1, 2, 3}
    newest = {(r.package, r.version): r.seq for r in service.latest(service.sink(spark, out, "package_scans")).collect()}
    want = {}
    for i, line in enumerate(every):
        if i not in (7, 8, 9, 10):
            e = json.loads(line)
            want[e["package"], e["version"]] = i
    assert newest == want and service.scan_of(spark, out, "a", "1.0.0").first().seq == want["a", "1.0.0"]


def test_a_crash_between_sinks_is_made_good_from_the_checkpoint(spark, tmp_path, scores):
    every, out, cp = written(tmp_path), str(tmp_path / "out"), str(tmp_path / "cp")

    def fail(name, batch):
        if (name, batch) == ("risk_timeline", 1):
            raise RuntimeError("lost")

    q = service.start(spark, str(tmp_path / "in"), scores, out, cp, files_per_batch=3, wrote=fail)
    with pytest.raises(Exception, match="lost"):
        q.awaitTermination(240)
    assert service.sink(spark, out, "risk_timeline").where("batch = 1").count() and not service.sink(spark, out, "reviews").where("batch = 1").count()
    service.start(spark, str(tmp_path / "in"), scores, out, cp, files_per_batch=3).awaitTermination(240)
    assert state(spark, out) == twin(spark, every, scores)
    (tmp_path / "in" / "9999.json").write_text(json.dumps({"package": "a", "version": "9.0.0", "seq": 999}) + "\n")
    service.start(spark, str(tmp_path / "in"), scores, out, cp, files_per_batch=3).awaitTermination(240)
    assert service.scan_of(spark, out, "a", "9.0.0").first().risk_level == "critical"
