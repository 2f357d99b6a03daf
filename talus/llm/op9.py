"""Query op9: near-duplicate groups of all documents over four-word shingles."""

from talus.llm.near_dedup import near_groups
from talus.session import table


def op9_minhash_bayes(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents"), size=4, percent=80)


QUERIES = {"op9_minhash_bayes": op9_minhash_bayes}
ORACLES: dict[str, str] = {}
