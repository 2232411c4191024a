"""Quality rules: base figures of a text and cross-document line frequency per host.

A line's key is the line without white space at its ends, A-Z lower-cased, hashed. Per host the distinct
documents that hold a key are counted, lines above the limits are taken out, and a document that lost more
than ``max_lost`` of its words is depleted and rejected.

Exact copies of a document must not make its lines look like boilerplate: documents of one host with the same
whole text, told by its hash, count once. Any other two texts are two documents.

Edge cases: a null or empty text has no words, fails the base rules and stays in the result. A null host is a
host of its own. Repeated rows are judged alike, each with a row of its own. Blank lines have no key. Extra
columns are ignored by ``rate`` and handed through by ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import KEY, SPACE, identity, join_measured, lower_ascii, numbered, strip, words
from weekloom.session import stage


@dataclass(frozen=True)
class LineLimits:
    """A line is boilerplate of its host beyond both limits."""

    documents: int = 10
    share: float = 0.01
    max_lost: float = 0.5
    min_words: int = 50
    max_repeat: float = 0.5


def count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def with_repeats(df: DataFrame) -> DataFrame:
    """``_n_repeat_words``: words inside three-word windows that occur twice or more.

    Each array is a column of its own, so a lambda never computes it again for every element. Sorting is
    skipped for the many texts without a repeated window.
    """
    placed = F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    same = lambda k, x: F.coalesce(F.get("_placed", k)["h"] == x["h"], F.lit(False))
    return (
        df.withColumn(
            "_placed", F.when(F.size(F.array_distinct("_grams")) == F.size("_grams"), none).otherwise(placed)
        )
        .withColumn("_twice", F.filter("_placed", lambda x, k: same(k - 1, x) | same(k + 1, x)))
        .withColumn("_at", F.sort_array(F.transform("_twice", lambda x: x["i"])))
        # A window adds the words up to the next repeated window, three at most.
        .withColumn(
            "_added",
            F.transform("_at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1) - p, F.lit(3)))),
        )
        .withColumn("_n_repeat_words", F.aggregate("_added", F.lit(0), lambda a, x: a + x).cast("long"))
    )


def figures(docs: DataFrame, text: Column, limits: LineLimits) -> DataFrame:
    """Per-text figures; ``docs`` with the columns below, nothing shuffled."""
    df = docs.withColumn("_text", F.coalesce(text, F.lit(""))).withColumn("_w", words(F.col("_text")))
    w, n = F.col("_w"), F.size("_w")
    df = df.withColumn(
        "_grams",
        F.transform(
            F.arrays_zip(*(F.slice("_w", k, F.greatest(n - 2, F.lit(0))).alias(f"w{k}") for k in (1, 2, 3))),
            lambda z: F.xxhash64(z["w1"], z["w2"], z["w3"]),
        ),
    ).withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    keyed = F.transform(
        "_lines",
        lambda x: F.struct(F.xxhash64(strip(lower_ascii(x))).alias("h"), F.size(words(x)).alias("n")),
    )
    base = with_repeats(df).select(
        *docs.columns,
        n.cast("long").alias("_n_words"),
        (F.length("_text") - count_of(F.col("_text"), " \t\n\x0b\f\r")).cast("long").alias("_word_chars"),
        count_of(F.col("_text"), "#*$%&|<>").cast("long").alias("_n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_n_dup_lines"),
        "_n_repeat_words",
        F.xxhash64("_text").alias("_who"),
        keyed.alias("_keys"),
    )
    failed = (F.col("_n_words") < limits.min_words) | (
        100 * F.col("_n_repeat_words") > 100 * limits.max_repeat * F.col("_n_words")
    )
    return base.withColumn("_base_failed", failed)


def frequent_lines(base: DataFrame, limits: LineLimits) -> DataFrame:
    """Keys (host, h) held by more distinct documents of a host than the limits allow.

    Counting goes through distinct (host, key, text) rows, which are combined before each shuffle, so the copies
    of a text and a line that a third of all documents hold are spread over all tasks.
    """
    total = base.select("_host", "_who").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_all"))
    held = (
        base.select("_host", "_who", F.explode(F.transform("_keys", lambda k: k["h"])).alias("_h"))
        .distinct()
        .groupBy("_host", "_h")
        .agg(F.count(F.lit(1)).alias("_docs"))
        .where(F.col("_docs") > limits.documents)
    )
    return held.join(total, "_host").where(F.col("_docs") > limits.share * F.col("_all")).select("_host", "_h", "_docs")


def judged(docs: DataFrame, limits: LineLimits) -> DataFrame:
    """Rows of ``docs`` (``_text_in``, ``_host`` and what is to be handed through) with figures and verdict."""
    base = numbered(figures(docs, F.col("_text_in"), limits).drop("_text_in"), "quality")
    lines = base.select("_row", "_host", F.explode("_keys").alias("k")).select(
        "_row", "_host", F.col("k.h").alias("_h"), F.col("k.n").alias("_n")
    )
    frequent = stage(frequent_lines(base, limits), "frequent-lines")
    lost = (
        join_measured(lines, frequent, ["_host", "_h"], "inner", 32 + F.octet_length("_host"))
        .groupBy("_row")
        .agg(F.sum("_n").alias("_lost"), F.count(F.lit(1)).alias("_lost_lines"))
    )
    gone = F.coalesce("_lost", F.lit(0))
    return (
        base.drop("_keys", "_who")
        .join(lost, "_row", "left")
        .withColumn("_depleted", gone > limits.max_lost * F.col("_n_words"))
        .withColumn("_kept", ~F.col("_base_failed") & ~F.col("_depleted"))
        .withColumn("_lost", gone.cast("long"))
        .withColumn("_lost_lines", F.coalesce("_lost_lines", F.lit(0)))
    )


def host_key(host: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), host), F.lit(""))


def rate(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """One row per document: figures, words lost to frequent lines, verdict."""
    df = judged(
        docs.select("doc_id", F.col("text").alias("_text_in"), host_key(F.col("source")).alias("_host")),
        limits,
    )
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return df.select(
        "doc_id",
        *(F.col(f"_{x}").alias(x) for x in names),
        F.col("_lost").alias("n_frequent_words"),
        F.col("_lost_lines").alias("n_frequent_lines"),
    )


def keep(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """The rows of ``docs`` that pass, unchanged and with all their columns.

    Texts are neither staged nor shuffled for it: the rejected rows come back as 128-bit keys.
    """
    key = identity("doc_id", "text", "source")
    df = judged(docs.select(*(c.alias(k) for k, c in key.items()), F.col("text").alias("_text_in"), host_key(F.col("source")).alias("_host")), limits)
    rejected = stage(df.where("NOT _kept").select(*KEY).distinct(), "rejected")
    rows = docs.select(F.struct("*").alias("_doc"), *(c.alias(k) for k, c in key.items()))
    return join_measured(rows, rejected, KEY, "left_anti", 64).select("_doc.*")


SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
g AS (SELECT r, unnest(range(len(w) - 2)) AS i, unnest(w[1:len(w) - 2]) AS a, unnest(w[2:len(w) - 1]) AS b,
             unnest(w[3:len(w)]) AS c
      FROM d WHERE len(w) > 2),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n_rep FROM rep, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
l AS (SELECT r, host, x, lower_x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n FROM (
        SELECT r, host, x, translate(regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_x
        FROM (SELECT r, host, unnest(string_split(t, chr(10))) AS x FROM d)
        WHERE regexp_matches(x, '[^\x20\x09-\x0D]'))),
dl AS (SELECT r, count(*) - count(DISTINCT x) AS n_dup FROM l GROUP BY r),
tot AS (SELECT host, count(DISTINCT t) AS n_all FROM d GROUP BY host),
fr AS (SELECT l.host, lower_x, count(DISTINCT t) AS n_docs FROM l JOIN d USING (r) GROUP BY 1, 2),
bad AS (SELECT host, lower_x FROM fr JOIN tot USING (host) WHERE n_docs > 10 AND n_docs > 0.01 * n_all),
lost AS (SELECT r, sum(n) AS n_lost, count(*) AS n_lines FROM l JOIN bad USING (host, lower_x) GROUP BY r),
f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_rep, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lost, 0)::BIGINT AS n_frequent_words, coalesce(n_lines, 0)::BIGINT AS n_frequent_lines
  FROM d LEFT JOIN cov USING (r) LEFT JOIN dl USING (r) LEFT JOIN lost USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT n_frequent_words > 0.5 * n_words AS kept
FROM f
"""
