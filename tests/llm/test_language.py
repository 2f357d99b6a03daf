import random
from collections import Counter

import numpy as np

from talus.llm import op2
from talus.llm.language import ORDER, characters, estimate

PARTS = {"aa": ["an", "the", "ing", "re"], "bb": ["ung", "sch", "ein", "ß"], "cc": ["ción", "ñ", "que", "an"]}


def corpus(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        g = r.choice(list(PARTS))
        rows.append((i, " ".join("".join(r.choice(PARTS[g]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(5, 40))), g))
    return rows


def chance(counts, text_grams):
    """Interpolated Kneser-Ney by its textbook recursion over dictionaries."""
    levels = [Counter(int(g) & ((1 << 16 * n) - 1) for g in counts) if n == ORDER else None for n in range(ORDER + 1)]
    for n in range(ORDER - 1, 0, -1):
        levels[n] = Counter(g & ((1 << 16 * n) - 1) for g in levels[n + 1])
    ctx, kinds, d = {}, {}, {}
    for n in range(1, ORDER + 1):
        ones, twos = (sum(v == k for v in levels[n].values()) for k in (1, 2))
        d[n] = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
        for g, v in levels[n].items():
            ctx[n, g >> 16] = ctx.get((n, g >> 16), 0) + v
            kinds[n, g >> 16] = kinds.get((n, g >> 16), 0) + 1
    return levels, ctx, kinds, d


def test_entropy_equals_the_recursion():
    rows = corpus(40, 1)
    models = estimate([t for _, t, _ in rows], ["x"] * len(rows))
    train = [t for i, (_, t, _) in enumerate(rows) if i % 4 != 3]
    grams, _, counted = characters(train)
    levels, ctx, kinds, d = chance(grams[counted].tolist(), None)
    alphabet = max(2, len(levels[1]) + 1)

    def p(g, n):
        if n == 0:
            return 1 / alphabet
        g &= (1 << 16 * n) - 1
        h = (n, g >> 16)
        if h not in ctx:
            return p(g, n - 1)
        return max(levels[n].get(g, 0) - d[n], 0) / ctx[h] + d[n] * kinds[h] / ctx[h] * p(g, n - 1)

    probe = "the ingqe xyzre"
    g, _, c = characters([probe])
    want = -np.mean([np.log(p(int(x), ORDER)) for x in g[c]])
    assert abs(models.entropies([probe])[1][0, 0] - want) < 1e-4


def test_held_out_accuracy_and_defined_cases(spark, tmp_path):
    rows = corpus(400, 2) + [(900, None, "aa"), (901, "12 !?", "bb"), (902, "the", None), (None, "ein", "bb"), (5, "x" * 3000, "aa")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    frame.withColumn("score", frame.lang).write.parquet(f"{tmp_path}/documents.parquet")
    got = op2.op2_kneser_ney(spark, str(tmp_path)).collect()
    truth = {d: g for d, _, g in rows[:400] if d != 5}
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out]) >= 0.97
    by = {r.doc_id: r for r in got}
    assert by[900].lang_pred == by[901].lang_pred == "und" and by[900].score == 0 and len(got) == len(rows)
    frame.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert op2.op2_kneser_ney(spark, f"{tmp_path}/b").collect() == []
