"""MinHash near-dedup by a chosen-path set similarity join.

1. Documents with the same set of shingles become one class, so exact copies are one row from here on.
2. Every class has a MinHash sketch. In each of ``trees`` independent trees a class follows the values of
   randomly chosen sketch places: classes that agree stay in a node together. In nodes above ``leaf`` classes
   every class is first held against the node's smallest one, on full sets. A node whose classes are then known
   as one component has nothing left to find. If all but ``leaf`` / 2 of them are one component, the others meet
   every class of the node on full sets. Else the node branches on, each along its own chosen places,
   1 / similarity of them on average, as deep as ``depth``. What is then still too large is cut into blocks, and
   every pair of blocks is a node: slower, but whole.
3. Nodes are compared exhaustively on sketches; a star forest of the plausible pairs is confirmed on full
   sets. Nodes in which a plausible pair was refused are compared once more, on full sets, every class
   outside the largest component against all others. Only links between components need confirming, so a
   large group of near copies does not cost all its pairs.
4. Connected components give each document its class id.

At a similarity of 0.8 one tree of depth three finds a pair with probability 0.51; sixteen miss it with
probability 1e-5, and a sketch of 128 places is below ``doubt`` for such a pair with probability 3e-5.

Edge cases: null, empty and blank texts have an empty set, link with nothing and are kept. A text of fewer
words than a shingle is one shingle. Repeated rows are copies of each other. A null doc_id is passed over when
the smallest id is sought. Extra columns are ignored by ``group`` and handed through by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import KEY, identity, join_measured, numbered
from weekloom.llm.components import components
from weekloom.llm.words import NOT_SPACE, Words, group_cuts, mix, passes, whole_groups
from weekloom.session import join_small, stage

PLACES = 128
PATHS = "_node bigint, _c bigint"


@dataclass(frozen=True)
class NearDedup:
    shingle: int = 5
    percent: int = 80
    trees: int = 16
    start: int = 3
    leaf: int = 1024
    depth: int = 10
    doubt: float = 0.14
    seed: int = 7


def shingles(w: Words, first: int, last: int, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of words first..last-1."""
    h = w.hash[first:last]
    if not len(h):
        return h
    n = min(size, len(h))
    with np.errstate(over="ignore"):
        code = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            code = mix(code * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(code)


def coefficients(seed: int) -> tuple[np.ndarray, np.ndarray]:
    raw = mix(np.arange(1, 2 * PLACES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return raw[:PLACES] | np.uint64(1), raw[PLACES:]


def sketch(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per place 16 bits of the smallest hash of the set."""
    low = np.full(PLACES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(values), 4096):
            block = values[at : at + 4096]
            np.minimum(low, (block[:, None] * a + b).min(axis=0), out=low)
    return (mix(low) >> np.uint64(48)).astype(np.uint16)


def _sign(batches: Iterator[pa.RecordBatch], size: int, seed: int) -> Iterator[pa.RecordBatch]:
    a, b = coefficients(seed)
    for batch in batches:
        rows = []
        for _, part in passes(batch.column("_text")):
            w = Words(part, NOT_SPACE)
            for k in range(len(part)):
                s = shingles(w, w.cut[k], w.cut[k + 1], size)
                with np.errstate(over="ignore"):
                    s1, s2 = s.sum(dtype=np.uint64), mix(s + np.uint64(1)).sum(dtype=np.uint64)
                rows.append((len(s), s1.astype(np.int64), s2.astype(np.int64), sketch(s, a, b).tobytes() if len(s) else b""))
        n, s1, s2, sk = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in batch.schema.names if c != "_text"),
                pa.array(n, pa.int32()),
                pa.array(s1, pa.int64()),
                pa.array(s2, pa.int64()),
                pa.array(sk, pa.binary()),
            ],
            names=[*(c for c in batch.schema.names if c != "_text"), "_n", "_s1", "_s2", "_sketch"],
        )


def signed(docs: DataFrame, cfg: NearDedup, columns: str) -> DataFrame:
    """``docs`` (with ``_text``) with set size, 128-bit set signature and sketch instead of the text."""
    schema = f"{columns}, _n int, _s1 bigint, _s2 bigint, _sketch binary"
    return docs.mapInArrow(lambda batches: _sign(batches, cfg.shingle, cfg.seed), schema)


def _paths(batches: Iterator[pa.RecordBatch], cfg: NearDedup) -> Iterator[pa.RecordBatch]:
    """The first nodes of every class: one per tree, ``start`` places deep."""
    rng = np.random.default_rng(cfg.seed)
    chosen = [rng.choice(PLACES, cfg.start, replace=False) for _ in range(cfg.trees)]
    for batch in batches:
        if not batch.num_rows:
            continue
        sk = np.frombuffer(b"".join(batch.column("_sketch").to_pylist()), np.uint16).reshape(-1, PLACES)
        c = batch.column("_c").to_numpy(zero_copy_only=False)
        nodes = []
        for tree, places in enumerate(chosen):
            code = np.full(len(c), tree + 1, np.uint64)
            for p in places:
                code = step(code, sk[:, p], p)
            nodes.append(code.astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(nodes)), pa.array(np.tile(c, cfg.trees))], names=["_node", "_c"]
        )


def step(node: np.ndarray, value: np.ndarray, place) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(node * np.uint64(0xD6E8FEB86659FD93) + value.astype(np.uint64) * np.uint64(PLACES) + np.asarray(place).astype(np.uint64))


def _branch(batches: Iterator[pa.RecordBatch], extra: float) -> Iterator[pa.RecordBatch]:
    """Children of large nodes: one chosen place, and a second one for the share ``extra`` of the nodes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sk = np.frombuffer(b"".join(batch.column("_sketch").to_pylist()), np.uint16).reshape(-1, PLACES)
        c, node = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("_c", "_node"))
        node = node.astype(np.uint64)
        coin = mix(node + np.uint64(1))
        rows = np.arange(len(c))
        first = (coin % np.uint64(PLACES)).astype(np.int64)
        second = (first + 1 + (mix(coin) % np.uint64(PLACES - 1)).astype(np.int64)) % PLACES
        twice = mix(coin + np.uint64(2)).astype(np.float64) / 2**64 < extra
        children = np.concatenate([step(node, sk[rows, first], first), step(node, sk[rows, second], second)[twice]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(children.astype(np.int64)), pa.array(np.concatenate([c, c[twice]]))], names=["_node", "_c"]
        )


def first_nodes(classes: DataFrame, cfg: NearDedup) -> DataFrame:
    """(``_node``, ``_c``, ``_size``) of the first nodes with two classes or more."""
    rows = stage(classes.select("_sketch", "_c").mapInArrow(lambda b: _paths(b, cfg), PATHS), "paths")
    sizes = rows.groupBy("_node").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    return stage(rows.join(sizes, "_node"), "paths")


def mixed(rows: DataFrame) -> DataFrame:
    """Rows (``_node``, ``_c``, ``_label``) of the nodes that hold two components or more.

    ``_size``: classes of the node; ``_others``: those outside its largest component; ``_main``: whether the row is in it.
    """
    counts = rows.groupBy("_node", "_label").agg(F.count(F.lit(1)).alias("_n"))
    nodes = counts.groupBy("_node").agg(F.sum("_n").alias("_size"), F.max(F.struct("_n", "_label")).alias("_top"))
    nodes = nodes.withColumn("_others", F.col("_size") - F.col("_top._n")).where("_others > 0")
    return rows.join(nodes, "_node").select(
        "_node", "_c", "_label", "_size", "_others", (F.col("_label") == F.col("_top._label")).alias("_main")
    )


def asked(rows: DataFrame, block: int) -> DataFrame:
    """Nodes in which the classes outside the largest component meet all classes: its members in chunks, the others in each."""
    chunks = F.ceil((F.col("_size") - F.col("_others")) / block)
    mine = F.array(F.pmod(F.xxhash64("_c"), chunks))
    every = F.sequence(F.lit(0).cast("long"), chunks - 1)
    return rows.select(
        F.explode(F.when(F.col("_main"), mine).otherwise(every)).alias("_k"), "_node", "_c", "_label", (~F.col("_main")).alias("_ask")
    ).select(F.xxhash64("_node", "_k").alias("_node"), "_c", "_label", "_ask")


def below(large: DataFrame, classes: DataFrame, known: DataFrame, cfg: NearDedup) -> tuple[DataFrame, DataFrame]:
    """What is left to compare in and below ``large``: nodes (``_node``, ``_c``) to be compared on sketches, and nodes
    (``_node``, ``_c``, ``_label``, ``_ask``) to be compared on full sets.

    ``known`` has the component so far, ``_label``, of each class in them.
    """
    rows, share = large.select("_node", "_c"), 100 / cfg.percent - 1
    small, few = [], []
    for level in range(cfg.start, cfg.depth + 1):
        rows = stage(mixed(stage(rows.join(known, "_c"), "paths")), "mixed")
        fits, all_but = F.col("_size") <= cfg.leaf, F.col("_others") <= cfg.leaf // 2
        small.append(rows.where(fits).select("_node", "_c"))
        few.append(asked(rows.where(~fits & all_but), cfg.leaf))
        wide = rows.where(~fits & ~all_but)
        if wide.isEmpty():
            break
        if level == cfg.depth:
            small.append(block_pairs(wide, cfg.leaf // 2))
            break
        rows = (
            wide.join(classes.select("_c", "_sketch"), "_c")
            .select("_node", "_c", "_sketch")
            .mapInArrow(lambda b: _branch(b, share), PATHS)
        )
    return reduce(DataFrame.union, small), reduce(DataFrame.union, few)


def block_pairs(large: DataFrame, block: int) -> DataFrame:
    """Nodes for every pair of blocks of a node that is still large at full depth."""
    blocks = F.ceil(F.col("_size") / block).cast("int")
    mine = F.pmod(F.xxhash64("_node", "_c"), blocks).cast("int")
    pair = F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1),
        lambda o: F.xxhash64("_node", F.least(F.col("_mine"), o), F.greatest(F.col("_mine"), o)),
    )
    return (
        large.withColumn("_blocks", blocks)
        .withColumn("_mine", mine)
        .select(F.explode(pair).alias("_node"), "_c")
        .distinct()
    )


class Sets:
    """Union-find over the classes of one node."""

    def __init__(self, labels) -> None:
        self.at = list(range(len(labels)))
        first: dict[int, int] = {}
        for i, x in enumerate(labels):
            self.at[i] = first.setdefault(x, i)

    def find(self, i: int) -> int:
        while self.at[i] != i:
            self.at[i] = i = self.at[self.at[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.at[max(i, j)] = min(i, j)
        return i != j


def _plausible(batches: Iterator[pa.RecordBatch], cfg: NearDedup) -> Iterator[pa.RecordBatch]:
    """A star forest of the pairs in a node whose sketches agree often enough; (node, smaller, larger)."""
    need = (cfg.percent / 100 - cfg.doubt) * PLACES
    for part in whole_groups(batches, "_node"):
        nodes = part.column("_node").to_numpy()
        c, n = part.column("_c").to_numpy(), part.column("_n").to_numpy()
        sk = np.frombuffer(b"".join(part.column("_sketch").to_pylist()), np.uint16).reshape(-1, PLACES)
        out = []
        cuts = group_cuts(nodes)
        # Groups of two, the most frequent ones, in one pass.
        size = np.diff(cuts)
        two = cuts[:-1][size == 2]
        if len(two):
            near = ((sk[two] == sk[two + 1]).sum(axis=1) >= need) & fits(n[two], n[two + 1], cfg.percent)
            a, b = c[two][near], c[two + 1][near]
            out.append(np.stack([nodes[two][near], np.minimum(a, b), np.maximum(a, b)]))
        for lo, hi in zip(cuts[:-1][size > 2], cuts[1:][size > 2]):
            order = np.argsort(c[lo:hi], kind="stable") + lo
            pairs = forest(c[order], n[order], sk[order], need, cfg.percent)
            if pairs:
                a, b = np.array(pairs).T
                out.append(np.stack([np.full(len(a), nodes[lo]), a, b]))
        if out:
            node, a, b = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(a), pa.array(b)], names=["_node", "a", "b"])


def fits(n, m, percent):
    return 100 * np.minimum(n, m).astype(np.int64) >= percent * np.maximum(n, m).astype(np.int64)


def forest(c, n, sk, need, percent) -> list[tuple[int, int]]:
    """Edges that connect what plausible pairs connect; every class hangs on the smallest one it can."""
    joined, pairs = Sets(range(len(c))), []
    for i in range(len(c) - 1):
        rest = slice(i + 1, len(c))
        near = fits(n[i], n[rest], percent)
        hit = np.flatnonzero(near)
        hit = hit[(sk[i + 1 + hit] == sk[i]).sum(axis=1) >= need]
        for j in hit + i + 1:
            if joined.join(i, int(j)):
                pairs.append((c[i], c[j]))
    return pairs


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links in each node whose full sets are similar enough, as far as they join components.

    Rows: ``_node``, ``_c``, ``_label`` (component so far), ``_ask`` (compare it with all others) and ``_set``.
    Without a row to ask, all outside the largest component are asked.
    """
    for part in whole_groups(batches, "_node"):
        nodes, c = part.column("_node").to_numpy(), part.column("_c").to_numpy()
        label, ask = part.column("_label").to_numpy(), part.column("_ask").to_numpy(zero_copy_only=False)
        raw = part.column("_set").to_pylist()
        a, b = [], []
        cuts = group_cuts(nodes)
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            sets = [np.frombuffer(x, np.uint64) for x in raw[lo:hi]]
            who = np.flatnonzero(ask[lo:hi])
            if not len(who):
                names, count = np.unique(label[lo:hi], return_counts=True)
                who = np.flatnonzero(label[lo:hi] != names[np.argmax(count)])
            for i, j in similar(sets, who, Sets(label[lo:hi]), percent):
                a.append(c[lo + i])
                b.append(c[lo + j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def similar(sets: list[np.ndarray], who: np.ndarray, joined: Sets, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs (asked, other) that reach the similarity and join two components."""
    sizes = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(ids.max() + 1, np.int64)
    for i in who:
        mine = ids[starts[i] : starts[i + 1]]
        mark[mine] = 1
        common = np.add.reduceat(mark[ids], starts[:-1])
        mark[mine] = 0
        for j in np.flatnonzero(100 * common >= percent * (sizes + sizes[i] - common)):
            if joined.join(int(i), int(j)):
                yield int(i), int(j)


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The full set of each wanted class; a text that only shares the hash of the wanted text is left out."""
    for batch in batches:
        keep, out = [], []
        s1s, s2s = batch.column("_s1").to_pylist(), batch.column("_s2").to_pylist()
        for at, part in passes(batch.column("_text")):
            w = Words(part, NOT_SPACE)
            for k in range(len(part)):
                s = shingles(w, w.cut[k], w.cut[k + 1], size)
                with np.errstate(over="ignore"):
                    s1, s2 = s.sum(dtype=np.uint64), mix(s + np.uint64(1)).sum(dtype=np.uint64)
                if (int(s1.astype(np.int64)), int(s2.astype(np.int64))) == (s1s[at + k], s2s[at + k]):
                    keep.append(at + k)
                    out.append(s.tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("_c").take(pa.array(keep, pa.int64())), pa.array(out, pa.binary())], names=["_c", "_set"]
        )


def confirmed(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links of ``nodes`` (``_node``, ``_c``, ``_label``, ``_ask``)."""
    return (
        nodes.join(sets, "_c")
        .repartition("_node")
        .sortWithinPartitions("_node")
        .select("_node", "_c", "_label", "_ask", "_set")
        .mapInArrow(lambda b: _confirm(b, percent), "a bigint, b bigint")
    )


def plausible(nodes: DataFrame, classes: DataFrame, cfg: NearDedup) -> DataFrame:
    """(``_node``, ``a``, ``b``): the pairs in ``nodes`` that are worth confirming."""
    return (
        nodes.join(classes.select("_c", "_n", "_sketch"), "_c")
        .repartition("_node")
        .sortWithinPartitions("_node")
        .select("_node", "_c", "_n", "_sketch")
        .mapInArrow(lambda b: _plausible(b, cfg), "_node bigint, a bigint, b bigint")
    )


def star_links(pairs: DataFrame, sets: DataFrame, cfg: NearDedup) -> DataFrame:
    """(``a``, ``b``): confirmed links of ``pairs``, whose ``a`` are the centres of stars.

    A centre with very many partners is cut into chunks, many nodes with the same centre.
    """
    star = pairs.select("a", "b").distinct()
    degree = stage(star.groupBy("a").agg(F.count(F.lit(1)).alias("_deg")).where(F.col("_deg") > cfg.leaf), "hubs")
    chunks = F.ceil(F.coalesce("_deg", F.lit(1)) / cfg.leaf).cast("long")
    chunk = F.xxhash64("a", F.pmod(F.xxhash64("b"), chunks))
    star = stage(join_small(star, degree, "a", "left").select("a", "b", chunk.alias("_node")), "stars")
    centre = star.select("_node", F.col("a").alias("_c")).distinct().withColumn("_ask", F.lit(True))
    around = star.select("_node", F.col("b").alias("_c")).withColumn("_ask", F.lit(False))
    return confirmed(centre.union(around).withColumn("_label", F.col("_c")), sets, cfg.percent)


def labelled(df: DataFrame, parts: DataFrame, c: str, name: str) -> DataFrame:
    """``df`` with the component of class ``c``, itself where it is linked with none."""
    parts = parts.select(F.col("v").alias(c), F.col("component").alias(name))
    return df.join(parts, c, "left").withColumn(name, F.coalesce(name, c))


def class_links(classes: DataFrame, texts: DataFrame, cfg: NearDedup) -> DataFrame:
    """(``v``, ``component``) of classes that are linked with others. ``texts``: ``_text``, ``_text_hash``."""
    first = first_nodes(classes, cfg)
    nodes = first.where(F.col("_size") <= cfg.leaf).select("_node", "_c")
    large = first.where(F.col("_size") > cfg.leaf).select("_node", "_c")
    some_large = not large.isEmpty()
    pairs = plausible(nodes, classes, cfg)
    if some_large:
        heads = large.groupBy("_node").agg(F.min("_c").alias("a"))
        pairs = pairs.union(large.join(heads, "_node").where("_c != a").select("_node", "a", F.col("_c").alias("b")))
    pairs = stage(pairs, "plausible")
    wanted = stage(pairs.select(F.explode(F.array("a", "b")).alias("_c")).distinct(), "wanted")
    wanted = stage(wanted.join(classes.select("_c", "_text_hash", "_s1", "_s2"), "_c"), "wanted")
    sets = join_small(texts, wanted, "_text_hash", max_rows=1_000_000)
    sets = sets.select("_c", "_s1", "_s2", "_text").mapInArrow(lambda b: _sets(b, cfg.shingle), "_c bigint, _set binary")
    sets = stage(sets.groupBy("_c").agg(F.first("_set").alias("_set")), "sets")
    links = stage(star_links(pairs, sets, cfg), "links")
    parts = stage(components(links), "components")
    if some_large:
        # All classes of large nodes have their sets already.
        known = stage(labelled(large.select("_c").distinct(), parts, "_c", "_label"), "known")
        deep, few = below(large, classes, known, cfg)
        deep = stage(deep, "leaves")
        found = stage(plausible(deep, classes, cfg), "plausible")
        nodes, pairs = nodes.union(deep), pairs.union(found)
        links = links.union(star_links(found, sets, cfg)).union(confirmed(few, sets, cfg.percent))
        links = stage(links, "links")
        parts = stage(components(links), "components")
    # A pair stands in many nodes: it is labelled once, and only refused pairs look for their nodes.
    refused = labelled(labelled(pairs.select("a", "b").distinct(), parts, "a", "_la"), parts, "b", "_lb")
    refused = stage(refused.where("_la != _lb").select("a", "b"), "refused-pairs")
    refused = stage(pairs.join(refused, ["a", "b"], "left_semi").select("_node").distinct(), "refused")
    again = labelled(nodes.join(refused, "_node", "left_semi"), parts, "_c", "_label")
    # Classes that were plausible with nobody have no set here, and no link either.
    more = confirmed(again.withColumn("_ask", F.lit(False)), sets, cfg.percent)
    return components(stage(links.union(more), "links"))


def linked(rows: DataFrame, texts: DataFrame, cfg: NearDedup) -> DataFrame:
    """Staged ``rows`` (of ``signed``, with ``_id`` and ``_row``) with ``_component`` and ``_first``."""
    key = ["_s1", "_s2", "_n"]
    classes = numbered(
        rows.where("_n > 0")
        .groupBy(*key)
        .agg(F.min(F.struct("_text_hash", "_sketch")).alias("_one"))
        .select(*key, "_one.*"),
        "classes",
    ).withColumnRenamed("_row", "_c")
    parts = class_links(classes, texts, cfg)
    groups = classes.select(*key, "_c").join(parts.withColumnRenamed("v", "_c"), "_c", "left")
    groups = groups.select(*key, F.coalesce("component", "_c").alias("_g"))
    grouped = stage(rows.drop("_sketch", "_text_hash").join(groups, key, "left"), "grouped")
    first = F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "_row")))
    lowest = grouped.where("_g IS NOT NULL").groupBy("_g").agg(first.alias("_m"), F.min("_row").alias("_r"))
    return (
        grouped.join(lowest, "_g", "left")
        .withColumn("_component", F.when(F.col("_g").isNull(), F.col("_id")).otherwise(F.col("_m._id")))
        .withColumn("_first", F.col("_g").isNull() | (F.col("_row") == F.coalesce("_m._row", "_r")))
        .drop("_m", "_r")
    )


def hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text_hash"), F.col("text").alias("_text"))


def group(docs: DataFrame, cfg: NearDedup = NearDedup()) -> DataFrame:
    """One row per document with its set size, its component and whether it is the one that stays."""
    slim = docs.select(
        F.col("doc_id").alias("_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text_hash"),
        F.col("text").alias("_text"),
    )
    rows = numbered(signed(slim, cfg, "_id bigint, _text_hash bigint"), "signed")
    return linked(rows, hashed(docs), cfg).select(
        F.col("_id").alias("doc_id"),
        F.col("_n").cast("long").alias("n_shingles"),
        F.col("_component").alias("component_id"),
        (F.col("_id") == F.col("_component")).alias("kept"),
    )


def keep_first(docs: DataFrame, cfg: NearDedup = NearDedup()) -> DataFrame:
    """``docs`` with one document of each component, the one of the smallest doc_id.

    The others come back as 128-bit keys, so texts are not shuffled. Rows that agree in id and text have one
    key; of those that stay one row is picked.
    """
    key = {k: c.alias(k) for k, c in identity("doc_id", "text").items()}
    slim = docs.select(
        F.col("doc_id").alias("_id"),
        *key.values(),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text_hash"),
        F.col("text").alias("_text"),
    )
    rows = numbered(signed(slim, cfg, "_id bigint, _k1 bigint, _k2 bigint, _text_hash bigint"), "signed")
    marked = linked(rows, hashed(docs), cfg)
    keys = marked.groupBy(*KEY).agg(F.max("_first").alias("_stays"), (F.count_if(F.col("_g").isNotNull()) > 1).alias("_again"))
    keys = stage(keys.where("_again OR NOT _stays"), "near-keys")
    named = docs.select(F.struct("*").alias("_doc"), *key.values())
    out = join_measured(named, keys.select(*KEY), KEY, "left_anti", 64).select("_doc.*")
    again = keys.where("_again AND _stays").select(*KEY)
    if again.isEmpty():
        return out
    picked = join_measured(named, again, KEY, "left_semi", 64).groupBy(*KEY).agg(F.first("_doc").alias("_doc"))
    return out.union(picked.select("_doc.*"))


SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, x || ' ' || y AS g
  FROM (SELECT doc_id, unnest(w[1:len(w) - 1]) AS x, unnest(w[2:len(w)]) AS y FROM w WHERE len(w) > 1)
  UNION SELECT doc_id, w[1] FROM w WHERE len(w) = 1),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
ab AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS v, a AS c FROM ab UNION SELECT ab.b, r.c FROM r JOIN ab ON ab.a = r.v WHERE r.c < ab.b),
m AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(c, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(c, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.v = w.doc_id
"""
