import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talus.llm import near_dedup, pieces, toxicity
from talus.session import BATCH_BYTES, in_python

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unset(spark):
    spark.conf.unset(KEY)
    yield
    spark.conf.unset(KEY)


def sizes():
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    return run


def docs(spark, rows, size):
    return spark.range(0, rows, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(" ab"), size // 3)).alias("text"))


@pytest.mark.parametrize("step", ["sketch", "toxicity", "encode"])
def test_steps_of_the_pipeline_hand_python_no_large_batch(spark, unset, step):
    few = docs(spark, 20, 50)
    if step == "sketch":
        near_dedup.near_groups(few)
    elif step == "toxicity":
        toxicity.scored(few, toxicity.train([], []))
    else:
        pieces.encoded(few)
    got = docs(spark, 9000, 2000).mapInArrow(sizes(), "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 9000 and max(r.bytes for r in got) < 1.2 * BATCH_BYTES


def test_long_rows_pass_whole_and_a_set_bound_stays(spark, unset):
    got = in_python(docs(spark, 3, BATCH_BYTES + 1000), sizes(), "rows long, bytes long").collect()
    assert [r.rows for r in got] == [1, 1, 1] and min(r.bytes for r in got) > BATCH_BYTES
    spark.conf.set(KEY, "8m")
    assert [r.rows for r in in_python(docs(spark, 3, 2000), sizes(), "rows long, bytes long").collect()] == [3]
    assert spark.conf.get(KEY) == "8m"
