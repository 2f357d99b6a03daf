from talus.llm import line_dedup


def test_no_plan_forms_the_lines_more_than_once(spark, monkeypatch):
    """The driver plans, compiles and logs each plan, so its memory follows the largest one."""
    forms = []

    def counted(df):
        forms.append(df._jdf.queryExecution().optimizedPlan().toString().count("Generate "))
        return df

    monkeypatch.setattr(line_dedup, "written", lambda df, *a, f=line_dedup.written: f(counted(df), *a))
    lines = [f"a line of its own, number {i} of them" for i in range(6)]
    rows = [(1, "\n".join(lines)), (2, lines[2] + "\n" + lines[3] + "x"), (3, lines[4].replace("own", "oxn") + "\nanother line altogether here")]
    got = counted(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {r.row.doc_id: (r.n_lines, r.n_removed) for r in got} == {1: (6, 5), 2: (2, 2), 3: (2, 1)}
    assert max(forms) <= 4
