import random
import re
from collections import Counter

from talus.llm.mixing import by_position, mix_plan, mixed


def targets(sizes):
    """Shares by plain repeated resharing."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, cap = sum(sizes.values()), {s: 3 * n for s, n in sizes.items()}
    full = set()
    while True:
        rest = total - sum(cap[s] for s in full)
        w = sum(weight[s] for s in order if s not in full)
        out = {s: cap[s] if s in full else rest * weight[s] / w for s in order}
        over = {s for s in order if s not in full and out[s] > cap[s]}
        if not over:
            return out
        full |= over


def corpus(seed):
    r = random.Random(seed)
    rows = [(i, " ".join("w" * r.randint(1, 5) for _ in range(r.randint(0, 60))), r.choice(["a", "b", "c", "d", "é"])) for i in range(400)]
    rows += [(i, "x y z", "tiny") for i in range(400, 403)] + [(500, None, "a"), (501, "", None), (502, "p q", None), (None, "n m", "b"), (7, "again", "a"), (7, "again", "a")]
    return rows


def test_targets_taken_words_and_limits(spark):
    rows = corpus(1)
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = by_position(mix_plan(frame)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"\S+", t or ""))
    want = targets(sizes)
    by_target = Counter()
    for r in got:
        assert r.taken <= 3 * r.size
        by_target[round(r.target, 6)] += r.taken
    assert len(got) == len(rows)
    shared = Counter(round(v, 6) for v in want.values())
    assert set(shared) == set(by_target)
    assert all(abs(t * shared[t] - n) <= shared[t] for t, n in by_target.items())
    places = [r.position for r in got if r.position is not None]
    assert places == sorted(places) and all(0 <= p <= 1 for p in places)


def test_the_mix_holds_what_the_plan_takes(spark):
    rows = corpus(2)
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    plan, copies = Counter(), Counter()
    for r in mix_plan(frame).collect():
        plan[r.doc_id] += r.taken
    out = mixed(frame)
    assert out.columns == frame.columns
    for r in out.collect():
        copies[r.doc_id] += len(r.text.split())
    assert {k: v for k, v in plan.items() if v} == dict(copies)
    assert mixed(frame.limit(0)).collect() == [] and mix_plan(frame.limit(0)).collect() == []


def test_null_ids_are_spread_and_columns_of_any_name_stay(spark):
    rows = [(None, f"w{i} " * 50, "a", "d", 1, 2.0) for i in range(60)] + [(i, "x " * 50, "a", "d", 1, 2.0) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, _doc string, words int, position double")
    plan = [r for r in mix_plan(frame).collect() if r.doc_id is None]
    assert len({r.position for r in plan}) == 60 and max(r.position for r in plan) - min(r.position for r in plan) > 0.5
    got = mixed(frame)
    assert got.columns == frame.columns and sorted(map(repr, got.collect())) == sorted(map(repr, frame.collect()))
    assert all(str(r.position) != "-0.0" for r in plan)
