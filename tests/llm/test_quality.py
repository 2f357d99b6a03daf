import zlib

import numpy as np
import pyarrow as pa

from talus.llm.buffers import text_view
from talus.llm.op11 import op11_byte_convolution
from talus.llm.quality import CHUNK, OVERLAP, PAD, PLACES, STRIDE, WINDOW, Net, _gradients, chunked, fitted, scored, train

SF = "/root/testdata/sf0.1"


def parts(*texts):
    return chunked(*text_view(pa.array(texts, pa.large_string())))


def test_chunks_cover_whole_texts_and_overlap():
    for n in (0, 1, OVERLAP, CHUNK, CHUNK + 1, 2 * CHUNK - OVERLAP, 5000):
        data = np.random.default_rng(n).integers(0, 128, n, dtype=np.uint8)
        chunks, starts = parts("x", data.tobytes().decode(), "y")
        mine = chunks[starts[1] : starts[2]]
        back = np.concatenate([mine[0], *[c[OVERLAP:] for c in mine[1:]]]) if len(mine) else []
        assert (back[:n] == data).all() and (back[n:] == PAD).all() and len(back) - n < CHUNK + 1


def test_pooling_equals_plain_loops():
    net, (chunks, _) = Net.new(np.random.default_rng(1)), parts("Some text of words, " * 60, "é")
    got, _ = net.pooled(chunks)
    for chunk, values in zip(chunks, got):
        windows = [net.bytes_[chunk[p * STRIDE : p * STRIDE + WINDOW]].ravel() @ net.filters for p in range(PLACES)]
        assert np.allclose(np.maximum(np.max(windows, axis=0), 0), values, atol=1e-5)


def test_gradients_equal_differences():
    r = np.random.default_rng(3)
    net = Net.new(r)
    net.unit_bias += 0.3
    (chunks, starts), y, weight = parts("abc def " * 200, "Zz. zZ!", "x | y | z " * 9), np.array([1, 0, 1], np.float32), np.array([0.5, 1, 0.3], np.float32)

    def loss():
        p = 1 / (1 + np.exp(-net.sums(chunks, starts)))
        return -(weight * np.where(y == 1, np.log(p), np.log(1 - p))).sum()

    for array, gradient in zip(net.arrays(), _gradients(net, chunks, starts, y, weight)):
        for at in np.argsort(-np.abs(gradient).ravel())[:3]:
            held = array.ravel()[at]
            array.ravel()[at] = held + 1e-3
            above = loss()
            array.ravel()[at] = held - 1e-3
            below = loss()
            array.ravel()[at] = held
            assert abs((above - below) / 2e-3 - gradient.ravel()[at]) < 0.02 * max(1, abs(gradient.ravel()[at]))


def test_scores_stay_the_same_in_any_company_and_after_packing():
    net, texts = Net.unpack(Net.new(np.random.default_rng(5)).pack()), ["one two three", "", "long " * 3000, "one two three"]
    together, alone = net.score(*parts(*texts)), [net.score(*parts(t))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-6) and together[0] == together[3]


def test_one_class_and_no_labels():
    assert train([], np.zeros(0, bool)).score(*parts("a")).tolist() == [0.5]
    assert train(["a", "b"], np.ones(2, bool)).score(*parts("a"))[0] > 0.99
    assert train(["a", "b"], np.zeros(2, bool)).score(*parts("a"))[0] < 0.01


def test_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    known = docs.join(labels.selectExpr("doc_id", "quality as label"), "doc_id").select("doc_id", "text", "label").toPandas()
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in known.doc_id])
    net = fitted(docs.select("doc_id", "text"), labels.selectExpr("doc_id", "quality as label"), most=400)
    test = known[held]
    score = np.concatenate([net.score(*parts(*test.text[i : i + 100])) for i in range(0, len(test), 100)])
    assert (score[test.label == 1] >= 0.3).mean() > 0.97 and (score[test.label == 0] < 0.3).mean() > 0.75


def test_nulls_repeats_clashing_names_long_and_empty_tables(spark):
    net = Net.new(np.random.default_rng(2))
    rows = [(1, "a b", 0.1), (1, "a b", 0.2), (None, None, None), (2, "", 1.0), (3, "w" * 2_000_000, 1.0)]
    got = scored(spark.createDataFrame(rows, "doc_id long, text string, score double"), net).collect()
    assert sorted(r.row.text or "" for r in got) == sorted(t or "" for _, t, _ in rows)
    by = {r.row.text: r.score for r in got}
    assert by[None] == by[""] and all(0 <= x <= 1 for x in by.values())
    assert scored(spark.createDataFrame([], "doc_id long, text string"), net).count() == 0


def test_query_without_usable_labels(spark, tmp_path):
    spark.createDataFrame([(1, "a", "en"), (2, None, "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = op11_byte_convolution(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.held_out, r.score, r.predicted) for r in rows) == [(i, zlib.crc32(str(i).encode()) % 5 == 0, 0.5, 1) for i in (1, 2)]


def test_equal_texts_of_one_batch_score_equally_at_any_place():
    net, r = Net.new(np.random.default_rng(5)), np.random.default_rng(6)
    for n in (1, 2, 3, 30, 200):
        others = ["".join(map(chr, r.integers(32, 127, r.integers(0, 1500)))) for _ in range(n)]
        score = net.score(*parts("one two three" * 50, *others, "one two three" * 50))
        assert score[0] == score[-1]
