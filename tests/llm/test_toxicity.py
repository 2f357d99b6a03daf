import itertools
import random

import numpy as np

from pyspark.sql import functions as F

from talus.llm import op3
from talus.llm.toxicity import NORMS, _kernel, _landmark_table, fitted, gapped, scored, train, units

BAD = ["grobnix", "flurbel", "zankwit"]


def corpus(n, seed):
    r = random.Random(seed)
    parts = ["an", "the", "ing", "re", "st", "on", "ea", "nd", "bel", "gro"]
    texts, labels = [], []
    for i in range(n):
        words = ["".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(BAD))
        texts.append(" ".join(words))
        labels.append(toxic)
    return texts, np.array(labels)


def test_held_out_accuracy_gaps_and_edges():
    texts, labels = corpus(800, 1)
    model = train(texts, labels)
    test, want = corpus(400, 2)
    got = model.score(test) >= 0.3
    assert got[want].mean() >= 0.95 and got[~want].mean() <= 0.05
    low, hidden, empty, blank = model.score(["the ingre stonea", "the grob*nix ingre", "", " \n\0 "])
    assert hidden > low >= empty == blank
    assert train([], np.zeros(0, bool)).score(["x"])[0] < 0.01


def plain_features(word):
    """Subsequences of four letters with their weights, by listing them all."""
    letters = [(i, c) for i, c in enumerate(word) if c.isalnum()]
    # the borders stand right beside the first and the last letter
    letters = [(letters[0][0] - 1, "^"), *letters, (letters[-1][0] + 1, "^")]
    out = {}
    for four in itertools.combinations(range(len(letters)), 4):
        if four[-1] - four[0] <= 5:
            marks = letters[four[-1]][0] - letters[four[0]][0] - (four[-1] - four[0])
            key = "".join(letters[i][1] for i in four)
            out[key] = out.get(key, 0) + 0.6 ** (four[-1] - four[0] - 3) * 0.92**marks
    return {k: v / NORMS[min(len(letters) - 2, 24)] for k, v in out.items()}


def test_kernel_equals_listing_all_subsequences():
    words = ["grobnix", "g.r.o.b.n.i.x", "g r o b n i x", "grob nix", "gro*bnix", "stone", "abcabcabc", "ab", "moron", "mmoorroonn"]
    kinds, table = _landmark_table(words)
    got = _kernel(words, kinds, table)
    maps = [plain_features(w) for w in words]
    want = [[sum(v * b.get(k, 0) for k, v in a.items()) for b in maps] for a in maps]
    assert np.allclose(got, want, atol=1e-5)


def test_every_gapped_form_of_an_insult_is_caught_and_clean_texts_are_not():
    texts, labels = corpus(1200, 4)
    model = train(texts, labels)
    for word in BAD:
        forms = [word, ".".join(word), "-".join(word), word.upper(), *gapped(word), word[:4] + "q" + word[4:], word + "!!", "(" + word + ")"]
        score = model.score([f"the ingre {form} stonea an" for form in forms])
        kept = np.array([len([c for c in f if c.isalpha()]) >= len(word) for f in forms])
        assert (score[kept] >= 0.3).all(), [f for f, s in zip(forms, score) if s < 0.3]
        # a letter that another stands for takes its subsequences with it: most of these forms, not all
        assert (score[~kept] >= 0.3).mean() >= 0.5
    clean, want = corpus(600, 6)
    assert (model.score([t for t, y in zip(clean, want) if not y]) >= 0.3).mean() <= 0.02
    found = model.sentences("The ingre stonea. An ing GROB-NIX then! And the end.")
    assert [s >= 0.3 for _, s in found] == [False, True, False] and found[1][0] == "an ing grob-nix then"


def test_spelled_out_letters_are_one_unit_and_sentences_part_pairs():
    u = units(["say i d i o t now", "a", "to be. or", "..."])
    assert u.size.tolist() == [3, 5, 3, 1, 2, 2, 2] and u.text.tolist() == [0, 0, 0, 1, 2, 2, 2]
    assert u.pairable.tolist() == [True, True, False, False, True, False, False]


def test_curve_makes_the_sampled_shares_good():
    texts, labels = corpus(900, 7)
    rare = train(texts, labels, (0.05, 1.0))
    assert rare.score(["the ingre"])[0] < train(texts, labels).score(["the ingre"])[0] + 1e-9


def test_columns_of_any_name_and_repeated_rows(spark):
    texts, labels = corpus(200, 8)
    rows = [(i, t, "s", 1.5, "r", 2) for i, t in enumerate(texts)] + [(7, "grobnix", "s", 1.5, "r", 2)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, weights double, `row` string, label int")
    marks = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)], "doc_id long, label int")
    got = scored(docs, fitted(docs, marks)).select("row.*", F.col("score").alias("chance")).collect()
    assert sorted(tuple(r)[:6] for r in got) == sorted(rows)
    assert len({r.chance for r in got if r.text == "grobnix"}) == 1
    assert scored(docs.limit(0), fitted(docs.limit(0), marks)).count() == 0


def test_query_shape_and_empty_tables(spark, tmp_path):
    texts, labels = corpus(300, 3)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(900, None, "x"), (901, "", "x"), (None, "grobnix", "x"), (5, "y" * 5000, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, int(y)) for i, y in enumerate(labels)] + [(5, None), (None, 1)]
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = op3.op3_subsequence_svm(spark, str(tmp_path))
    got = out.collect()
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/b/labels.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, score string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert {r.predicted for r in op3.op3_subsequence_svm(spark, f"{tmp_path}/b").collect()} == {0}
