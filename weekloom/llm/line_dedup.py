"""Line dedup: every line stays in the first document that holds it.

Hashed lines are range-partitioned by (hash, document, position). The range includes the document, so one very
common line spreads over many ranges. Within its range, each hash is sorted by document and position, and the
first occurrence is streamed to the rows after it. Only a hash that stands first in a range can have begun in an
earlier one; the true first documents of these, one hash for each range, are looked up and override. No
row ever meets all others of its hash. The result per document is its keep bitmap in run lengths (kept, dropped,
kept, ...), never text.

Edge cases: a null text counts as one empty line. Keys under ``min_chars`` code points are never dropped. Rows
with one doc_id are one document for the question who holds a line first, and all of them keep it. Null
doc_ids come first, as one document. Repeated rows each get a row. Extra columns are ignored by ``plan`` and
handed through by ``apply``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.llm.common import KEY, identity, join_measured, lower_ascii, strip, with_text
from weekloom.session import stage

FIRST = -(2**63)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def dropped_lines(rows: DataFrame, min_chars: int = 10) -> DataFrame:
    """(key, ``_at``) of each line to drop. ``rows``: ``_k1``, ``_k2``, ``_doc_id``, ``_text``."""
    key = strip(lower_ascii(F.col("_line")))
    lines = (
        rows.select(*KEY, "_doc_id", F.posexplode(split_lines(F.col("_text"))).alias("_at", "_line"))
        .select(*KEY, "_doc_id", "_at", key.alias("_key"))
        .where(F.length("_key") >= min_chars)
        .select(
            # 128 bits: two documents' lines meet only if both hashes agree.
            F.xxhash64("_key").alias("_h"),
            F.xxhash64(F.lit(1), "_key").alias("_h2"),
            F.coalesce("_doc_id", F.lit(FIRST)).alias("_d"),
            "_at",
            *KEY,
        )
    )
    lines = stage(lines, "lines")
    dealt = lines.repartitionByRange("_h", "_h2", "_d", "_at").withColumn("_range", F.spark_partition_id())
    dealt = stage(dealt, "lines-by-range")
    # One hash for each range: broadcast, as there are no more ranges than tasks.
    open_ = dealt.groupBy("_range").agg(F.min(F.struct("_h", "_h2")).alias("m")).select("m.*").distinct()
    begun = dealt.join(F.broadcast(open_), ["_h", "_h2"]).groupBy("_h", "_h2").agg(F.min("_d").alias("_begun"))
    inside = Window.partitionBy("_range", "_h", "_h2").orderBy("_d", "_at")
    first = F.first("_d").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        dealt.withColumn("_first", first)
        .join(F.broadcast(stage(begun, "lines-begun")), ["_h", "_h2"], "left")
        .where(F.col("_d") > F.coalesce("_begun", "_first"))
        .select(*KEY, "_at")
    )


def with_bitmaps(rows: DataFrame, min_chars: int = 10) -> DataFrame:
    """``rows`` with ``_n`` (lines), ``_gone`` (sorted positions of dropped lines) and ``_from`` / ``_to``.

    Segment i of kept lines is [from, to); a dropped run lies between two segments.
    """
    gone = dropped_lines(rows, min_chars).groupBy(*KEY).agg(F.sort_array(F.collect_set("_at")).alias("_gone"))
    gone = stage(gone, "dropped")
    near = lambda k, x: F.coalesce(F.abs(F.get("_gone", k) - x) == 1, F.lit(False))
    return (
        join_measured(rows, gone, KEY, "left", 96 + 4 * F.size("_gone"))
        .withColumn("_gone", F.coalesce("_gone", F.array().cast("array<int>")))
        .withColumn("_lines", split_lines(F.col("_text")))
        .withColumn("_n", F.size("_lines"))
        .withColumn("_starts", F.filter("_gone", lambda x, i: ~near(i - 1, x)))
        .withColumn("_ends", F.filter("_gone", lambda x, i: ~near(i + 1, x)))
        .withColumn("_from", F.concat(F.array(F.lit(0)), F.transform("_ends", lambda x: x + 1)))
        .withColumn("_to", F.concat("_starts", F.array("_n")))
    )


def keep_runs() -> Column:
    """The bitmap in run lengths: kept, dropped, kept, ..., kept."""
    return F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size("_starts")),
            lambda i: F.when(
                i < F.size("_starts"),
                F.array(F.get("_to", i) - F.get("_from", i), F.get("_ends", i) - F.get("_starts", i) + 1),
            ).otherwise(F.array(F.get("_to", i) - F.get("_from", i))),
        )
    )


def kept_text() -> Column:
    """The kept lines of a text, joined by line feeds."""
    return F.array_join(
        F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.size("_starts")),
                lambda i: F.slice("_lines", F.get("_from", i) + 1, F.get("_to", i) - F.get("_from", i)),
            )
        ),
        "\n",
    )


def rows_of(docs: DataFrame, *more: Column) -> DataFrame:
    key = identity("doc_id", "text")
    return docs.select(
        *more, F.col("doc_id").alias("_doc_id"), F.col("text").alias("_text"), *(c.alias(k) for k, c in key.items())
    )


def plan(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Per document the number of lines, those dropped, the keep bitmap ``keep_runs``, and the kept text."""
    return with_bitmaps(rows_of(docs), min_chars).select(
        F.col("_doc_id").alias("doc_id"),
        F.col("_n").cast("long").alias("n_lines"),
        F.size("_gone").cast("long").alias("n_dropped"),
        keep_runs().alias("keep_runs"),
        kept_text().alias("kept_text"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: counts, bitmap and the hash of what is kept."""
    return plan(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


def apply(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` without the dropped lines; ``n_chars``, where there is one, follows. Null stays null."""
    df = with_bitmaps(rows_of(docs, F.struct("*").alias("_doc")), min_chars).withColumn(
        "_new", F.when(F.size("_gone") > 0, kept_text()).otherwise(F.col("_text"))
    )
    return with_text(df, "_new")


SQL = r"""
WITH l AS (
  SELECT r, doc_id, i, x, translate(regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, unnest(ls) AS x, unnest(range(len(ls))) AS i
        FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
m AS (SELECT *, length(k) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY k) AS gone FROM l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
