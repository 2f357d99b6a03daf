"""The queries of this package."""

import corpus_pipeline
from talus.llm import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12, op13

MODULES = (op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12, op13)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items() if sql}
