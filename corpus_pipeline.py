"""Documents to a training mix: five stages, each written as Parquet and read again by the next.

Edge cases: null, empty and very short texts fail the base rules of the first stage and go. A null source is a source
and a host of its own, a null doc_id ranks before all others. Exact copies and repeated rows leave one row behind the
third stage. Empty tables give an empty mix. Extra columns, also such as share a name with a column of the operators,
are handed on unchanged by all stages but the last, whose columns are the mix's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weekloom.llm import decontaminate, line_dedup, mixing, near_dedup, quality_rules
from weekloom.llm.common import table
from weekloom.session import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.apply(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The setting of op6: two-word shingles, a similarity of 0.8.
    return near_dedup.keep_first(docs, near_dedup.NearDedup(shingle=2))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.taken(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near dedup", near),
    ("decontamination", benchmark),
    ("mix", mix),
]

#: The similarity search and text surgery of the stages have no SQL form; their operators are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
