import pyarrow as pa

from talus.operators import prompts
from talus.sources import calls, facts


def test_a_text_is_masked_once_and_null_texts_give_no_facts(monkeypatch):
    count, whole = [], calls.masked
    monkeypatch.setattr(calls, "masked", lambda text: count.append(text) or whole(text))
    schema = pa.schema([("dep", pa.string()), ("path", pa.string()), ("fact", pa.string()), *[(n, {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}.get(k, pa.list_(pa.string()))) for n, k in (c.split() for c in facts.FACT.split(", ")[1:])]])
    text = 'defmodule M do\n  @before_compile M\n  System.cmd("a")\nend\n'
    batch = pa.RecordBatch.from_pydict({"dep": ["p", "p"], "path": ["a", "b"], "content": [None, text]})
    rows = [r for b in facts._batches(iter([batch]), schema) for r in b.to_pylist()]
    assert [(r["path"], r["fact"], r["line"]) for r in rows] == [("b", "call", 3), ("b", "literal", 3), ("b", "hook", 2)]
    assert count == [text]


def test_a_snippet_needs_one_meeting_of_file_and_findings(spark):
    found = spark.createDataFrame([("p", "a", 1, "x"), ("p", "a", 1, "y"), ("p", "a", 9, "x"), ("p", "none", 1, "x"), ("p", "a", 3, "x")], "dep string, path string, line int, check_id string")
    made = prompts.snippets(found, spark.createDataFrame([("p", "a", "  one\ntwo\nthree\n")], "dep string, path string, content string"), 1)
    assert sorted(map(tuple, made.collect())) == [
        ("p", "a", 1, "x", "one\ntwo"), ("p", "a", 1, "y", "one\ntwo"), ("p", "a", 3, "x", "two\nthree"), ("p", "a", 9, "x", ""), ("p", "none", 1, "x", ""),
    ]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
