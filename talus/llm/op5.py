"""Query op5: the 20 nearest rows of each embedding whose id is divisible by 20."""

from talus.llm.vectors import nearest
from talus.session import table


def op5_adaptive_scan(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


QUERIES = {"op5_adaptive_scan": op5_adaptive_scan}
ORACLES: dict[str, str] = {}
