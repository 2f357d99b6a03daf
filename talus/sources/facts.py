"""All facts of a source file in one pass: its calls, its string literals, its compile-time hooks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: The columns of each kind of fact, in the order that its reader gives them.
COLUMNS = {
    "call": ("line", "body", "module", "func", "empty_call", "literals", "compile_time"),
    "literal": ("line", "text"),
    "hook": ("kind", "event", "module", "line", "last"),
}
FACT = (
    "fact string, line int, body int, module string, func string, empty_call boolean, literals array<string>, compile_time boolean, "
    "text string, kind string, event string, last int"
)
_ORDER = [c.split()[0] for c in FACT.split(", ")[1:]]


#: Rows of facts that are sent on at once.
BATCH = 1 << 14


def _batches(found: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    # imported by the task: the readers of a session in use hold what can't be sent
    from talus.sources.calls import CallFacts, Literals, masked
    from talus.sources.hooks import Hooks

    call, literal, hook = CallFacts.func().eval, Literals.func().eval, Hooks.func().eval
    places = {fact: [_ORDER.index(c) for c in columns] for fact, columns in COLUMNS.items()}
    for batch in found:
        held: list[list] = [[] for _ in range(len(_ORDER) + 2)]  # row of the batch, fact, its columns

        def made() -> pa.RecordBatch:
            rows = pa.array(held[0], pa.int32())
            given = [pa.array(x, schema.field(i + 2).type) for i, x in enumerate(held[1:])]
            return pa.RecordBatch.from_arrays([batch.column(0).take(rows).cast(schema.field(0).type), batch.column(1).take(rows).cast(schema.field(1).type), *given], schema=schema)

        for at, content in enumerate(batch.column(2).to_pylist()):
            if not content:
                continue
            plain = masked(content)
            for fact, rows in (("call", call(content, plain)), ("literal", literal(content)), ("hook", hook(content, plain))):
                for row in rows:
                    whole = [None] * len(_ORDER)
                    for i, value in zip(places[fact], row):
                        whole[i] = value
                    for column, value in zip(held, (at, fact, *whole)):
                        column.append(value)
            if len(held[0]) >= BATCH:
                yield made()
                held = [[] for _ in held]
        if held[0]:
            yield made()


def file_facts(sources: DataFrame) -> DataFrame:
    """dep, path, fact and the columns of each fact of (dep, path, content) rows."""
    rows = sources.select("dep", "path", F.col("content").cast("string").alias("content"))
    schema = StructType(rows.schema.fields[:2] + StructType.fromDDL(FACT).fields)
    arrow = to_arrow_schema(schema)
    return rows.mapInArrow(lambda found: _batches(found, arrow), schema)


def of_kind(facts: DataFrame, fact: str) -> DataFrame:
    return facts.where(F.col("fact") == fact).select("dep", "path", *COLUMNS[fact])
