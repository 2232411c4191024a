"""Merkle manifest of a dataset: one digest for all rows, a proof for each, and folding of changed rows.

Leaves are digests of rows. Within a group leaves stand in order; every three neighbours become their parent, the
digest of their hex texts, until one node of the group is left; the groups' nodes form a tree of the same kind.

A parent keeps a copy of the SHA-256 state as it was before each of its child slots. Folding a changed leaf resumes,
level by level, the state before its slot with the replacement and the siblings to the right only; siblings to the
left are in the state already. The states are plain words (``midstate``), so they pass from task to task in tables.

A task builds whole chunks of 729 neighbouring nodes, six levels at once: chunks of all groups are dealt out by
hash, a group of any size is many chunks, and a hundred billion rows take four rounds up and four down. Places in a
group come from one range shuffle by (group, order) and sums of counts per partition, so a group that holds a
third of all rows is nowhere in one task. Only digests, places and chunk paths are ever shuffled, no texts.

Edge cases: a null in any field has an encoding of its own; a null group is a group, before all others. Repeated rows are
leaves of their own, next to each other; rows of equal order stand by digest. Empty and very long texts are ordinary
values. An empty table has no root and no rows. Columns that are not fields are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.llm import midstate as sha
from weekloom.llm.common import join_measured
from weekloom.llm.words import whole_groups
from weekloom.session import stage

FAN = 3
LEVELS = 6
CHUNK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Words of a path's level: slot, number of children, state before the slot, two siblings.
SLOT, COUNT, STATE, SIBLINGS, RECORD = 0, 1, slice(2, 10), 10, 26


def leaf(*values: Column) -> Column:
    """Digest of a row's fields: ``-`` for null, else byte count, colon, value."""
    text = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def placed(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Staged ``df`` with ``_pos``, its place in group ``_g`` from 0 on, and ``_n``, the group's rows."""
    dealt = stage(
        df.repartitionByRange("_g", *order)
        .sortWithinPartitions("_g", *order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33)),
        name,
    )
    whole = Window.partitionBy("_g")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        dealt.groupBy("_g", "_part")
        .agg(F.count(F.lit(1)).alias("_here"), F.min("_at").alias("_first"))
        .withColumn("_n", F.sum("_here").over(whole))
        .withColumn("_shift", F.coalesce(F.sum("_here").over(before), F.lit(0)) - F.col("_first"))
        .select("_g", "_part", "_n", "_shift")
    )
    size = F.octet_length("_g") + 32
    out = join_measured(dealt, stage(counts, name), ["_g", "_part"], "inner", size)
    return out.withColumn("_pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


@dataclass
class Level:
    """Nodes of a level, neighbours next to each other, and for each its parent, its slot and the parent's children."""

    digest: np.ndarray
    parent: np.ndarray
    slot: np.ndarray
    count: np.ndarray
    first: np.ndarray
    states: np.ndarray

    def records(self, at: np.ndarray) -> np.ndarray:
        """What folding needs of this level, for the nodes ``at``."""
        out = np.zeros((len(at), RECORD), np.uint32)
        p, slot = self.parent[at], self.slot[at]
        out[:, SLOT], out[:, COUNT], out[:, STATE] = slot, self.count[p], self.states[slot, :, p]
        for k in range(FAN - 1):
            place = k + (k >= slot)
            some = np.flatnonzero(place < self.count[p])
            out[some, SIBLINGS + 8 * k : SIBLINGS + 8 * k + 8] = self.digest[:, self.first[p[some]] + place[some]].T
        return out


def build(pos: np.ndarray, n: np.ndarray, digest: np.ndarray) -> tuple[list[Level], np.ndarray, np.ndarray]:
    """Levels of the chunks in a batch, the node that each chunk comes to, and where the leaves stand in each level.

    A chunk of a group of ``n`` nodes rises until one node is left, or by LEVELS levels. ``index[l]`` is a leaf's
    ancestor among the nodes that go up from level l, -1 beyond its chunk's last level.
    """
    height = np.searchsorted(FAN ** np.arange(LEVELS + 1), np.minimum(n, CHUNK))
    start = np.flatnonzero(pos % CHUNK == 0)
    chunk = np.cumsum(pos % CHUNK == 0) - 1
    top = np.empty((8, len(start)), np.uint32)
    levels, index = [], np.full((LEVELS, len(pos)), -1)
    at = np.arange(len(pos))  # each leaf's node among those of the level
    place, own, tall = pos % CHUNK, chunk, height
    for level in range(LEVELS + 1):
        done = tall == level
        top[:, own[done]] = digest[:, done]
        up = np.flatnonzero(~done)
        if not len(up):
            break
        moved = np.full(len(done), -1)
        moved[up] = np.arange(len(up))
        at = np.where(at >= 0, moved[at], -1)
        index[level] = at
        digest, place, own, tall = digest[:, up], place[up], own[up], tall[up]
        slot = place % FAN
        head = np.flatnonzero(slot == 0)
        parent = np.cumsum(slot == 0) - 1
        count = np.diff(np.append(head, len(slot)))
        states = np.empty((FAN, 8, len(head)), np.uint32)
        states[0] = state = sha.fresh(len(head))
        for k in range(FAN):
            some = np.flatnonzero(count > k)
            state = state.copy()
            state[:, some] = sha.compress(state[:, some], sha.hex_block(digest[:, head[some] + k]))
            if k + 1 < FAN:
                states[k + 1] = state
        levels.append(Level(digest, parent, slot, count, head, states))
        digest = sha.finish(state, count)
        at = np.where(at >= 0, parent[at], -1)
        place, own, tall = place[head] // FAN, own[head], tall[head]
    return levels, top, index


def fold(records: np.ndarray, active: np.ndarray, now: np.ndarray, proof: np.ndarray, seen: np.ndarray) -> None:
    """One level up for the ``active`` columns of ``now``; their siblings go into the running ``proof`` states."""
    slot, count = records[:, SLOT].astype(int), records[:, COUNT].astype(int)
    state = sha.compress(records[:, STATE].T, sha.hex_block(now[:, active]))
    for k in range(FAN - 1):
        some = np.flatnonzero(k + 1 < count)
        block = sha.hex_block(records[some, SIBLINGS + 8 * k : SIBLINGS + 8 * k + 8].T)
        proof[:, active[some]] = sha.compress(proof[:, active[some]], block)
        seen[active[some]] += 1
        right = np.flatnonzero(k >= slot[some])
        state[:, some[right]] = sha.compress(state[:, some[right]], block[:, right])
    now[:, active] = sha.finish(state, count)


def column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def digests(values: pa.ChunkedArray) -> np.ndarray:
    return sha.from_bytes(values.to_pylist())


def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of nodes to one node each."""
    for table in whole_groups(batches, "_c"):
        pos, n = column(table, "_pos"), column(table, "_n")
        _, top, _ = build(pos, n, digests(table.column("_digest")))
        first = np.flatnonzero(pos % CHUNK == 0)
        yield pa.RecordBatch.from_arrays(
            [
                table.column("_g").take(first).combine_chunks(),
                pa.array(pos[first] // CHUNK),
                pa.array(-(-n[first] // CHUNK)),
                pa.array(sha.to_bytes(top), pa.binary()),
            ],
            names=["_g", "_pos", "_n", "_digest"],
        )


def with_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For whole chunks: their rows, levels and indices, and of each chunk the path above it."""
    for table in whole_groups(batches, "_c"):
        above = column(table, "_above")
        paths, rows = table.filter(pa.array(above)), table.filter(pa.array(~above))
        n, pos = column(rows, "_n"), column(rows, "_pos")
        levels, _, index = build(pos, n, digests(rows.column("_digest")))
        raw = [np.frombuffer(p, "<u4").reshape(-1, RECORD) for p in paths.column("_path").to_pylist()]
        yield paths, rows, levels, index, np.cumsum(pos % CHUNK == 0) - 1, raw


def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of chunks to paths of their nodes, each of which is a chunk one round below, or a group."""
    for paths, rows, levels, index, chunk, raw in with_paths(batches):
        inside = [[] for _ in range(rows.num_rows)]
        for level, at in zip(levels, index):
            some = np.flatnonzero(at >= 0)
            for i, record in zip(some, level.records(at[some])):
                inside[i].append(record)
        whole = [np.concatenate([*map(np.atleast_2d, r), raw[c]]).astype("<u4").tobytes() for r, c in zip(inside, chunk)]
        yield pa.RecordBatch.from_arrays(
            [
                rows.column("_g").combine_chunks(),
                rows.column("_pos").combine_chunks(),
                rows.column("_name").combine_chunks(),
                pa.array(whole, pa.binary()),
                paths.column("_root").take(chunk).combine_chunks(),
                pc.coalesce(rows.column("_subroot"), paths.column("_subroot").take(chunk)).combine_chunks(),
            ],
            names=["_g", "_pos", "_name", "_path", "_root", "_subroot"],
        )


def folded(batches: Iterator[pa.RecordBatch], payload: list[str]) -> Iterator[pa.RecordBatch]:
    """Leaves with their proof and the root that the replaced leaf ``_new`` leads to."""
    for paths, rows, levels, index, chunk, raw in with_paths(batches):
        now, proof = digests(rows.column("_new")), sha.fresh(rows.num_rows)
        seen = np.zeros(rows.num_rows, np.int64)
        for level, at in zip(levels, index):
            some = np.flatnonzero(at >= 0)
            fold(level.records(at[some]), some, now, proof, seen)
        height = np.array([len(r) for r in raw], int)
        for k in range(height.max(initial=0)):
            record = np.stack([r[k] if k < len(r) else np.zeros(RECORD, np.uint32) for r in raw])
            some = np.flatnonzero(height[chunk] > k)
            fold(record[chunk[some]], some, now, proof, seen)
        yield pa.RecordBatch.from_arrays(
            [
                *(rows.column(c).combine_chunks() for c in payload),
                rows.column("_digest").combine_chunks(),
                paths.column("_subroot").take(chunk).combine_chunks(),
                paths.column("_root").take(chunk).combine_chunks(),
                pa.array(sha.to_bytes(sha.finish(proof, seen)), pa.binary()),
                pa.array(sha.to_bytes(now), pa.binary()),
            ],
            names=[*payload, "leaf", "subroot", "root", "proof", "folded_root"],
        )


def by_chunk(nodes: DataFrame) -> DataFrame:
    """Rows of a chunk together and in order, its path first."""
    return (
        nodes.withColumn("_c", F.expr(f"xxhash64(_g, (_pos + int(_above)) div {CHUNK})"))
        .repartition("_c")
        .sortWithinPartitions("_c", "_g", "_pos")
    )


def climb(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The nodes at the start of each round up, and after the last, which leaves one node for each group."""
    rounds, most = [nodes], 2
    while most > 1:
        chunks = by_chunk(rounds[-1].select("_g", "_pos", "_n", "_digest", F.lit(False).alias("_above")))
        rounds.append(stage(chunks.mapInArrow(up, "_g string, _pos long, _n long, _digest binary"), name))
        most = rounds[-1].agg(F.max("_n")).first()[0] or 0
    return rounds


def between(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Chunks of ``nodes``, each after the row of its path."""
    path = paths.select(
        "_g", (F.col("_pos") * CHUNK - 1).alias("_pos"), "_path", "_root", "_subroot", F.lit(True).alias("_above")
    )
    return by_chunk(nodes.withColumn("_above", F.lit(False)).unionByName(path, allowMissingColumns=True))


def descend(rounds: list[DataFrame], paths: DataFrame, name: str) -> DataFrame:
    """From the paths of the last round's chunks to those of the first round's nodes."""
    kind = "_g string, _pos long, _name string, _path binary, _root binary, _subroot binary"
    for nodes in reversed(rounds):
        missing = {c: F.lit(None).cast(t) for c, t in (("_name", "string"), ("_subroot", "binary")) if c not in nodes.columns}
        paths = stage(between(nodes.withColumns(missing), paths).mapInArrow(down, kind), name)
    return paths


@dataclass(frozen=True)
class Manifest:
    """A dataset's tree: placed leaves, and for each chunk of them subroot, root and the path between."""

    leaves: DataFrame
    paths: DataFrame
    payload: tuple[str, ...]

    def roots(self) -> DataFrame:
        """The groups' subroots under the root of all; a null group is empty, others have ``=`` in front."""
        return self.paths.where("_pos = 0").select(F.col("_g").alias("group"), "_subroot", "_root")

    def fold(self, new: str | None = None) -> DataFrame:
        """Every leaf with its proof and the root that it leads to if the digest in ``new`` stands in its place."""
        replaced = F.col("_digest") if new is None else F.coalesce(new, "_digest")
        leaves = self.leaves.select(*self.payload, "_g", "_pos", "_n", "_digest", replaced.alias("_new"))
        made = ("leaf", "subroot", "root", "proof", "folded_root")
        schema = [f"`{c}` {kind}" for c, kind in leaves.select(*self.payload).dtypes] + [f"{c} binary" for c in made]
        payload = list(self.payload)
        return between(leaves, self.paths).mapInArrow(lambda batches: folded(batches, payload), ", ".join(schema))


def manifest(rows: DataFrame, group: Column, order: Column, digest: Column, payload: dict[str, Column]) -> Manifest:
    """The tree over ``digest`` of ``rows``; ``payload`` columns (names without ``_`` in front) stay with each leaf."""
    named = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
    kept = [c.alias(k) for k, c in payload.items()]
    leaves = stage(rows.select(*kept, named.alias("_g"), order.alias("_by"), digest.alias("_digest")), "manifest-leaves")
    leaves = placed(leaves, ["_by", "_digest"], "manifest-placed")
    rounds = climb(leaves.select("_g", "_pos", "_n", "_digest"), "manifest-up")
    names = rounds[-1].select(
        F.lit("").alias("_g"), F.col("_g").alias("_name"), "_digest", F.col("_digest").alias("_subroot")
    )
    names = placed(names, ["_name"], "manifest-groups")
    above = climb(names.select("_g", "_pos", "_n", "_digest"), "manifest-root")
    top = above[-1].select(
        "_g",
        "_pos",
        F.lit(b"").alias("_path"),
        F.col("_digest").alias("_root"),
        F.lit(None).cast("binary").alias("_subroot"),
    )
    paths = descend([names, *above[1:-1]], top, "manifest-groups-down")
    paths = paths.select(
        F.col("_name").alias("_g"), F.lit(0).cast("long").alias("_pos"), "_path", "_root", "_subroot"
    )
    return Manifest(leaves, descend(rounds[1:-1], paths, "manifest-down"), tuple(payload))


def verified(docs: DataFrame) -> DataFrame:
    """Leaves, roots and proofs of ``docs``, and the roots after every second document (by checksum of its id) has
    lost its line ends: ``verified`` tells whether the root noticed nothing.

    A null doc_id has no checksum and is left alone.
    """
    tampered = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    whole = leaf(*map(F.col, FIELDS))
    other = leaf(*(tampered if c == "text" else F.col(c) for c in FIELDS))
    made = manifest(
        docs.select(*FIELDS),
        F.col("source"),
        F.col("doc_id"),
        whole,
        {"doc_id": F.col("doc_id"), "changed": F.when(hit, other)},
    )
    hexed = lambda c: F.lower(F.hex(c))
    return made.fold("changed").select(
        "doc_id",
        hexed("leaf").alias("leaf"),
        hexed("subroot").alias("subroot"),
        hexed("root").alias("root"),
        hexed("proof").alias("proof_sha256"),
        hexed("folded_root").alias("folded_root"),
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


#: Leaf of a row, with {t} for its text.
_LEAF = "sha256(" + " || ".join(
    f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{t}")
) + ")"
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT for x in string_split(doc_id::VARCHAR, '')]),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"""
SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || source, '') AS g, {_LEAF.format(t="text")} AS leaf,
         CASE WHEN {_CRC} % 2 = 0 THEN {_LEAF.format(t="replace(text, chr(10), '')")} END AS new
  FROM documents),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY g) AS n,
         row_number() OVER () AS r
  FROM d),
low AS (
  SELECT g, 0 AS l, p, leaf AS h, n FROM placed
  UNION ALL
  SELECT g, l + 1, p // 3, sha256(string_agg(h, '' ORDER BY p)), (any_value(n) + 2) // 3 FROM low WHERE n > 1
  GROUP BY g, l, p // 3),
sub AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS n FROM low WHERE n = 1),
top AS (
  SELECT 0 AS l, p, h, n FROM sub
  UNION ALL
  SELECT l + 1, p // 3, sha256(string_agg(h, '' ORDER BY p)), (any_value(n) + 2) // 3 FROM top WHERE n > 1
  GROUP BY l, p // 3),
f AS (
  SELECT r, g, 0 AS l, p, n, coalesce(new, leaf) AS now, '' AS proof FROM placed
  UNION ALL
  SELECT r, f.g, f.l + 1, f.p // 3, (any_value(f.n) + 2) // 3,
         sha256(string_agg(CASE WHEN low.p = f.p THEN now ELSE h END, '' ORDER BY low.p)),
         proof || coalesce(string_agg(h, '' ORDER BY low.p) FILTER (low.p <> f.p), '')
  FROM f JOIN low ON f.g = low.g AND f.l = low.l AND f.p // 3 = low.p // 3 WHERE f.n > 1
  GROUP BY r, f.g, f.l, f.p, proof),
t AS (
  SELECT r, 0 AS l, sub.p, sub.n, f.now, f.proof FROM f JOIN sub USING (g) WHERE f.n = 1
  UNION ALL
  SELECT r, t.l + 1, t.p // 3, (any_value(t.n) + 2) // 3,
         sha256(string_agg(CASE WHEN top.p = t.p THEN now ELSE h END, '' ORDER BY top.p)),
         proof || coalesce(string_agg(h, '' ORDER BY top.p) FILTER (top.p <> t.p), '')
  FROM t JOIN top ON t.l = top.l AND t.p // 3 = top.p // 3 WHERE t.n > 1
  GROUP BY r, t.l, t.p, proof)
SELECT doc_id, leaf, sub.h AS subroot, top.h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = top.h AS verified
FROM placed JOIN t USING (r) JOIN sub USING (g) JOIN top ON top.n = 1 WHERE t.n = 1
"""
