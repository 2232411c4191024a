"""Mixing sources to target weights by a low-discrepancy source schedule.

Each source's documents are shuffled by a seeded hash and laid end to end, twice over, as no document may go
in a third time. Slot t of the mix has the point t * golden ratio modulo 1, as a 32-bit fraction; the sources'
cumulative targets map it to a source, whose slot of rank r gives the r-th block of ``block`` words of its
line. The schedule ends where the targets are used up: its last slot is cut there. What a source gives follows
from its slots alone, so it comes within a few blocks of its target, and any stretch of the mix holds the
sources close to their shares. A slot beyond a source's two passes stays empty.

Nothing is ordered in one task but the list of sources, of which there is one row each: positions and ranks
are prefix sums over hash buckets and over slot chunks, so a source with a third of all words is spread.

Edge cases: a null or empty text has size 0 and is never taken. A null source is a source of its own, last in
order. Repeated rows are documents of their own. Without words every target is 0 and there are no slots. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.llm.common import words
from weekloom.session import join_small, stage

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 64
BUCKETS = 4096
CHUNK = 4096
SEED = "mix-1"
#: The golden ratio's fraction in units of 2 ** -32, rounded to an odd number: all 2 ** 32 points come once a period.
GOLDEN = 2654435769
CIRCLE = 1 << 32


def source_targets(docs: DataFrame, weights: tuple[int, ...], share: float, limit: int) -> DataFrame:
    """One row per source: number, size, target, and its whole words.

    Targets fill up by weight: the sources sorted by limit / weight reach their limits in this order, and the
    level of the rest is the largest level along the way.
    """
    by_code, every = Window.orderBy(F.col("_source").asc_nulls_last()), Window.partitionBy()
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), "_no").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0))
    return (
        docs.groupBy("_key", "_source")
        .agg(F.sum("_size").alias("_source_size"))
        .withColumn("_no", F.row_number().over(by_code))
        .withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_no") - 1) % len(weights) + 1))
        .withColumn("_cap", limit * F.col("_source_size"))
        .withColumn(
            "_level",
            (F.lit(share) * F.sum("_source_size").over(every) - before("_cap"))
            / (F.sum("_weight").over(every) - before("_weight")),
        )
        .withColumn(
            "_target", F.least(F.col("_cap").cast("double"), F.col("_weight") * F.max("_level").over(every))
        )
        .select("_key", "_no", "_source_size", "_target", F.floor("_target").alias("_goal"))
    )


def line_up(docs: DataFrame) -> DataFrame:
    """``_start``: words of the same source before the document, in shuffled order."""
    bucket = ["_no", "_bucket"]
    sums = docs.groupBy(*bucket).agg(F.sum("_size").alias("_sum"))
    w = Window.partitionBy("_no").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*bucket, F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*bucket).orderBy("_shuffle", "doc_id", "_size")
    return (
        docs.withColumn("_n", F.row_number().over(inside))
        .withColumn("_sum", F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(offsets, bucket)
        .withColumn("_start", F.col("_offset") + F.col("_sum") - F.col("_size"))
        .drop("_sum", "_offset", "_shuffle")
    )


def point(t: Column) -> Column:
    """``t`` times the golden ratio modulo 1, in units of 2 ** -32; two short products, so nothing overflows."""
    high, low = F.shiftright(t, 16).bitwiseAND(0xFFFF), t.bitwiseAND(0xFFFF)
    return ((high * F.lit(GOLDEN)) % F.lit(CIRCLE) * F.lit(1 << 16) + low * F.lit(GOLDEN)) % F.lit(CIRCLE)


def slots(sources: DataFrame, block: int) -> DataFrame:
    """(``_no``, ``_rank``, ``_slot``, ``_words``): the schedule, ranked per source."""
    wanted, cells = sources.where("_goal > 0").agg(F.coalesce(F.sum("_goal"), F.lit(0)), F.count(F.lit(1))).first()
    total = -(-wanted // block)
    upto = F.sum("_goal").over(Window.orderBy("_no").rowsBetween(Window.unboundedPreceding, 0))
    edge = lambda c: F.floor(c.cast("double") / F.lit(float(wanted or 1)) * F.lit(float(CIRCLE)))
    # As many cells as sources: each cell sees few edges, and the equality of cells carries the join.
    cell = lambda c: F.floor(c * F.lit(max(cells, 1)) / F.lit(CIRCLE))
    edges = (
        sources.where("_goal > 0")
        .withColumn("_high", edge(upto))
        .withColumn("_low", edge(upto - F.col("_goal")))
        .where("_low < _high")
        .withColumn("_cell", F.explode(F.sequence(cell(F.col("_low")), cell(F.col("_high") - 1))))
        .select("_no", "_low", "_high", "_cell")
    )
    points = sources.sparkSession.range(total).select(F.col("id").alias("_slot"), point(F.col("id")).alias("_point"))
    placed = (
        join_small(points.withColumn("_cell", cell(F.col("_point"))), edges, "_cell")
        .where("_low <= _point AND _point < _high")
        .select("_no", "_slot", F.floor(F.col("_slot") / CHUNK).alias("_chunk"))
    )
    counts = placed.groupBy("_no", "_chunk").agg(F.count(F.lit(1)).alias("_count"))
    w = Window.partitionBy("_no").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_no", "_chunk", F.coalesce(F.sum("_count").over(w), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_no", "_chunk").orderBy("_slot")
    return (
        placed.withColumn("_n", F.row_number().over(inside))
        .join(before, ["_no", "_chunk"])
        .select(
            "_no",
            (F.col("_before") + F.col("_n") - 1).alias("_rank"),
            "_slot",
            F.least(F.lit(block).cast("long"), wanted - F.col("_slot") * block).alias("_words"),
        )
    )


def prepared(docs: DataFrame, weights: tuple[int, ...], share: float, limit: int) -> tuple[DataFrame, DataFrame]:
    """Documents lined up per source, and the sources; both staged."""
    sized = stage(
        docs.select(
            "doc_id",
            F.col("source").alias("_source"),
            F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_key"),
            F.size(words(F.col("text"))).cast("long").alias("_size"),
        ),
        "mix-sizes",
    )
    sources = stage(source_targets(sized, weights, share, limit), "mix-sources")
    code = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    shuffled = join_small(sized, sources, "_key").select(
        "doc_id",
        "_no",
        "_size",
        "_source_size",
        "_target",
        code.alias("_shuffle"),
        F.conv(F.substring(code, 1, 3), 16, 10).cast("int").alias("_bucket"),
    )
    return stage(line_up(shuffled), "mix-line"), sources


def schedule(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    limit: int = 2,
    block: int = BLOCK_WORDS,
) -> DataFrame:
    """The mix as rows (slot, source number, document, first word, number of words); its order is ``_slot``, ``_turn``,
    ``_start``."""
    line, sources = prepared(docs, weights, share, limit)
    placed = stage(slots(sources, block), "mix-slots")
    runs = (
        line.where("_size > 0")
        .withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(limit - 1))))
        .withColumn("_from", F.col("_start") + F.col("_turn") * F.col("_source_size"))
    )
    first, last = F.floor(F.col("_from") / block), F.floor((F.col("_from") + F.col("_size") - 1) / block)
    low = F.greatest(F.col("_from") - F.col("_rank") * block, F.lit(0))
    high = F.least(F.col("_from") + F.col("_size") - F.col("_rank") * block, F.col("_words"))
    return (
        runs.withColumn("_rank", F.explode(F.sequence(first, last)))
        .join(placed, ["_no", "_rank"])
        .withColumn("_taken", high - low)
        .where("_taken > 0")
        .withColumn("_first", F.col("_rank") * block + low - F.col("_from"))
    )


def taken(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    limit: int = 2,
    block: int = BLOCK_WORDS,
) -> DataFrame:
    """Per document its size, its source's size and target, the words that the mix takes of it, and its first slot.

    The words of a source's slots run along its line, so a document's part needs no list of pieces.
    """
    line, sources = prepared(docs, weights, share, limit)
    placed = stage(slots(sources, block), "mix-slots")
    given = stage(placed.groupBy("_no").agg(F.sum("_words").alias("_given")), "mix-given")
    words_of = F.coalesce("_given", F.lit(0))
    part = lambda turn: F.greatest(
        F.lit(0), F.least("_size", words_of - F.col("_start") - F.lit(turn) * F.col("_source_size"))
    )
    served = join_small(line.withColumn("_rank", F.floor(F.col("_start") / block)), given, "_no", "left")
    return (
        served.withColumn("_taken", sum((part(k) for k in range(1, limit)), part(0)).cast("long"))
        .join(placed.select("_no", "_rank", "_slot"), ["_no", "_rank"], "left")
        .select(
            "doc_id",
            F.col("_size").alias("size"),
            F.col("_source_size").alias("source_size"),
            F.col("_target").alias("target"),
            F.col("_taken").alias("taken"),
            F.when(F.col("_taken") > 0, F.col("_slot")).alias("first_slot"),
        )
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no
  FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(no - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM s),
v AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)::DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, no, source_size, least(cap::DOUBLE, weight * max(level) OVER ()) AS target FROM v),
g AS (
  SELECT *, sum(goal) OVER (ORDER BY no)::BIGINT AS upto, sum(goal) OVER ()::BIGINT AS wanted
  FROM (SELECT source, no, floor(target)::BIGINT AS goal FROM t)),
e AS (
  SELECT *, floor((upto - goal)::DOUBLE / wanted::DOUBLE * 4294967296::DOUBLE)::BIGINT AS low,
         floor(upto::DOUBLE / wanted::DOUBLE * 4294967296::DOUBLE)::BIGINT AS high
  FROM g WHERE goal > 0),
k AS (SELECT unnest(range(((max(wanted) + 63) // 64)::BIGINT)) AS t, max(wanted) AS wanted FROM e),
q AS (
  SELECT t, least(64, wanted - 64 * t)::BIGINT AS words,
         ((((t >> 16) & 65535) * 2654435769) % 4294967296 * 65536 + (t & 65535) * 2654435769) % 4294967296 AS point
  FROM k),
h AS (
  SELECT e.source, t, words, row_number() OVER (PARTITION BY e.source ORDER BY t) - 1 AS rank
  FROM q JOIN e ON low <= point AND point < high),
z AS (SELECT source, sum(words)::BIGINT AS given FROM h GROUP BY source),
p AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, coalesce(z.given, 0) AS given,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix-1' || coalesce(d.doc_id::VARCHAR, 'null')), d.doc_id, d.size
                            ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN z ON z.source IS NOT DISTINCT FROM d.source),
r AS (
  SELECT *, (greatest(0, least(given - pos, size)) + greatest(0, least(given - source_size - pos, size)))::BIGINT AS taken
  FROM p)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN h.t END AS first_slot
FROM r LEFT JOIN h ON h.source IS NOT DISTINCT FROM r.source AND h.rank = pos // 64
"""
