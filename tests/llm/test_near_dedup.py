import random
import re

from talus.llm.near_dedup import least_matches, near_groups


def brute(rows, size, percent):
    sets = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc_id] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    ids = sorted(sets)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def corpus(seed, n=160):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[r.choice(vocabulary) for _ in range(r.randint(20, 150))] for _ in range(12)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE two"), (5, "One  TWO"), (6, "x" * 5000)]
    for i in range(7, n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((100 + i * 7 % 1009, r.choice([" ", "\n"]).join(w)))
    return rows


def test_groups_equal_brute_force(spark):
    rows = corpus(1)
    frame = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, kept string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_groups(frame, 4, 80).collect()}
    assert got == brute(rows, 4, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_groups(frame, 5, 80).collect()}
    assert got == brute(rows, 5, 80)


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = "a b c d e f g"
    frame = spark.createDataFrame([(3, text), (3, text), (1, text), (None, text), (9, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_groups(frame, 4).collect())
    assert got == [(-1, None, True), (1, 1, True), (3, 1, False), (3, 1, False), (9, 9, True)]
    assert near_groups(frame.limit(0)).collect() == []


def test_prune_bound_keeps_true_pairs():
    assert all(m < n * 0.8 for m, n in zip(least_matches(0.8, 1e-8), range(16, 97, 16)))
