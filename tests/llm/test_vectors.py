import numpy as np

from talus.llm.vectors import nearest, scan


def brute(rows, k, every):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows])
    out = {}
    for i, v in rows:
        if i % every == 0:
            score = np.einsum("ij,j->i", x, np.array(v))
            out[i] = [(int(ids[j]), score[j]) for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
    return out


def recall(spark, rows, k=20, every=10, **fit):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    got = {}
    for r in nearest(frame, k, every, **fit).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows, k, every)
    exact = {i: np.array(v) for i, v in rows}
    for q, found in got.items():
        assert len(found) == len(want[q]) and len({i for i, _ in found}) == len(found)
        assert found == sorted(found, key=lambda t: (-t[1], t[0]))
        assert all(abs(s - exact[q] @ exact[i]) < 1e-9 for i, s in found)
    assert set(got) == set(want)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    return hit / sum(map(len, want.values()))


def test_recall_on_random_vectors_of_unequal_norms(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((1500, 24)) * r.uniform(0.3, 2, (1500, 1))
    assert recall(spark, [(i, list(map(float, v))) for i, v in enumerate(x)]) >= 0.93


def test_copies_of_one_vector_keep_their_smallest_ids(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((300, 8)).astype(np.float32)
    x[50:200] = x[50]
    assert recall(spark, [(i, list(map(float, v))) for i, v in enumerate(x)]) >= 0.95


def test_defined_cases(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], "a"), (20, [0.0, 0.0], "b"), (1, [1.0, nan], "c"), (2, None, "d"), (3, [2.0, 1.0], "e"), (4, [1.0], "f"), (None, [1.0, 1.0], "g"), (5, [None, 1.0], "h"), (3, [2.0, 1.0], "i"), (6, [-1.0, 0.5], "j")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    assert [tuple(r) for r in nearest(frame, 20, 20).collect()] == [(0, 1, 3, 2.0), (0, 2, 6, -1.0)]
    assert nearest(frame.limit(0), 20, 20).collect() == []


def test_recall_with_a_sample_of_a_twentieth(spark):
    r = np.random.default_rng(5)
    x = r.standard_normal((6000, 48))
    assert recall(spark, [(i, list(map(float, v))) for i, v in enumerate(x)], every=40, sample_rows=300) >= 0.9
    centres = 3 * r.standard_normal((40, 48))
    x = centres[r.integers(0, 40, 6000)] + r.standard_normal((6000, 48))
    assert recall(spark, [(i, list(map(float, v))) for i, v in enumerate(x)], every=40, sample_rows=300) >= 0.9


def test_queries_in_small_cells_visit_more(spark):
    r = np.random.default_rng(6)
    x = r.standard_normal((400, 6))
    x[:3] = x[:3] / 100 + np.eye(6)[0] * 50
    assert recall(spark, [(i, list(map(float, v))) for i, v in enumerate(x)], every=1, wanted=0.0) >= 0.3


def test_most_pairs_are_abandoned_before_the_last_block():
    r = np.random.default_rng(7)
    centres = 2 * r.standard_normal((10, 64))
    points = (centres[r.integers(0, 10, 4000)] + r.standard_normal((4000, 64))).astype(np.float32)
    counts = []
    q, p = scan(points[:100], np.full(100, np.inf, np.float32), points, 20, tally=counts)
    pairs, reached = map(sum, zip(*counts[1:]))
    assert reached < 0.3 * pairs
    far = ((points[:100, None] - points[None, :]) ** 2).sum(axis=2)
    near = np.argsort(far, axis=1)[:, :20]
    found = set(zip(q.tolist(), p.tolist()))
    assert np.mean([(i, j) in found for i in range(100) for j in near[i].tolist()]) >= 0.97
