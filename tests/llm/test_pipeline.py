import random

import corpus_pipeline


def test_stages_keep_clean_documents_and_columns(spark, tmp_path):
    r = random.Random(4)
    word = lambda: "".join(r.choice(["an", "the", "ing", "re", "st", "on"]) for _ in range(r.randint(1, 4)))
    rows, labels = [], []
    for i in range(240):
        text = "\n".join(" ".join(word() for _ in range(12)) for _ in range(3))
        toxic = i % 4 == 0
        rows.append((i, text + (" grobnix flurbel zankwit" if toxic else ""), "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(500, rows[1][1], "en", "s0", 1), (501, rows[2][1] + " more", "en", None, 1), (502, None, "en", "s1", 0), (None, "alone here in this row", "en", "s1", 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        seen[name] = docs.collect()
        assert docs.columns == frame.columns or name == "encode"
    toxic = {i for i in range(240) if i % 4 == 0}
    left = {x.doc_id for x in seen["toxicity"]}
    assert len(left & toxic) <= 3 and {i for i in range(240)} - toxic <= left and {500, 501, 502, None} <= left
    lines = {x.doc_id for x in seen["line_dedup"]}
    assert 500 not in lines and 1 in lines and None in lines
    assert all(x.piece_ids for x in seen["encode"] if x.text)
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == len(seen["encode"])


def test_positions_follow_the_mix_and_empty_tables_pass(spark, tmp_path):
    rows = [(i, f"word{i} " * 30 + "\n" + f"line {i} of its own and long", "en", f"s{i % 3}", 9) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    kept = frame
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, f"{tmp_path}/a")
    mixed = corpus_pipeline.mix(spark, kept, "").collect()
    got = corpus_pipeline.run(spark, f"{tmp_path}/a").orderBy("position").collect()
    assert [r.doc_id for r in got] == [r.doc_id for r in mixed] and len({r.position for r in got}) == len(got)
    frame.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/b/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").collect() == []
