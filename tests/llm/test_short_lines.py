from talus.llm.line_dedup import dedup_lines


def test_exact_repeats_go_at_every_length_and_near_ones_only_when_long(spark):
    rows = [(1, "Read more\nhome\n\n\t\na line that is long enough to count"), (2, "Read more\nhomes\n\n\t\na line that is long enough to count!"), (3, "home"), (4, "x\nx")]
    got = {r.row.doc_id: (r.row.text, r.n_removed) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), exact=1).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("homes\n\n\t", 2), 3: ("", 1), 4: ("x", 1)}
