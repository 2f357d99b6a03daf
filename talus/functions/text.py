"""Text expressions and the entropy of byte strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def byte_entropy(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_bytes, entropy (bits a byte, rounded to 6 places) of each row; empty and null texts have none to report.

    One pass over the texts without a shuffle: an Arrow function counts the bytes of each.
    """
    held = rows.where(F.length(text) > 0).select(key, F.encode(text, "UTF-8").alias("_bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bits = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for i, value in enumerate(batch.column(1)):
                counts = np.bincount(np.frombuffer(value.as_buffer(), np.uint8))
                counts = counts[counts > 0]
                sizes[i] = n = counts.sum()
                bits[i] = np.log2(n) - (counts * np.log2(counts)).sum() / n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(bits)], [key, "n_bytes", "entropy"])

    made = T.StructType([held.schema[key], T.StructField("n_bytes", T.LongType()), T.StructField("entropy", T.DoubleType())])
    return held.mapInArrow(run, made).withColumn("entropy", F.round("entropy", 6))


def lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 1), line."""
    return rows.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line")).select(key, (F.col("at") + 1).cast("long").alias("line_no"), "line")


def pattern_hits(lines_: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """One row for each line and pattern that matches: all patterns in one pass over the lines."""
    hits = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), name) for name, p in patterns]))
    return lines_.withColumn("pattern", F.explode(hits)).drop("line")
