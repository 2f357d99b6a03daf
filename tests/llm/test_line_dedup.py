import random

from talus.llm.line_dedup import dedup_lines


def near(a, b):
    """Whether two strings are at most one edit apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def brute(rows, least=20):
    out, seen = {}, []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if t is None:
            out[d] = (None, 0, 0)
            continue
        lines, kept = t.split("\n"), []
        for line in lines:
            if len(line) < least or not line.strip(" "):
                kept.append(line)
                continue
            if not any(near(line, s) for s in seen):
                kept.append(line)
            seen.append(line)
        out[d] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def corpus(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdé ") for _ in range(r.randint(18, 40))).strip() + "x" * 4 for _ in range(12)] + [" " * 30, "", "short", "a" * 25]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(r.randint(0, 5)):
            s = r.choice(base)
            if r.random() < 0.6 and s:
                k = r.randrange(len(s))
                s = r.choice([s[:k] + s[k + 1 :], s[:k] + "q" + s[k:], s[:k] + "q" + s[k + 1 :], s[:k] + "qq" + s[k:]])
            lines.append(s)
        rows.append((i * 3 % 83, "\n".join(lines)))
    return rows + [(900, None), (901, "")]


def test_equal_to_brute_force(spark):
    rows = corpus(1)
    frame = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, gone string").repartition(3)
    out = dedup_lines(frame).select("row.*", "n_lines", "n_removed")
    assert out.columns == ["doc_id", "text", "gone", "n_lines", "n_removed"]
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in out.collect()} == brute(rows)


def test_null_ids_come_last_and_repeated_rows_agree(spark):
    line = "a line that is long enough to count"
    frame = spark.createDataFrame([(None, line), (5, line), (5, line), (6, line + "!\nother words of a second line")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in dedup_lines(frame).select("row.*").collect())
    assert got == [(0, ""), (5, line), (5, line), (6, "other words of a second line")]
    assert dedup_lines(frame.limit(0)).collect() == []


def test_columns_of_any_name(spark):
    rows = [(1, "a line that is long enough to count", 9, "x", "y", "z", 7), (2, "a line that is long enough to count!\nz", 8, "x", "y", "z", 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_removed long, _key string, doc string, `row` string, gone int")
    got = dedup_lines(frame).orderBy("row.doc_id").collect()
    assert [tuple(r.row) for r in got] == [rows[0], (2, "z", *rows[1][2:])] and [r.n_removed for r in got] == [0, 1]
