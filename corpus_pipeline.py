"""The corpus pipeline: quality classifier, n-gram Jaccard join, suffix-array dedup, mixing, BPE encoding.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns the documents that go on.
run(spark, sf_dir) applies them in turn. ORACLE_SQL is None, as SQL can't express the stages.
"""

from tidelog.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
