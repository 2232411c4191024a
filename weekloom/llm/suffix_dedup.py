"""Suffix-array dedup: bytes inside a string of ``length`` bytes that an earlier document also holds go.

1. Exact copies of a text are one text with its smallest id; only those are searched.
2. Every string of ``length`` bytes names one of its places by content alone, the one with the smallest hash
   of ``GRAM`` bytes. Equal strings name equal places, so they meet at one such anchor. Anchors of two
   documents or more set a bit in a map of fixed size. A string reaches half its spare bytes beyond the
   anchor on one side at least, so anchors in the map are looked up once more, longer by that half to the left
   and to the right; those of which either form stands in two documents go on, each with the bytes of the
   strings that name it. These bytes travel only for anchors that have several such surroundings; of the others
   every place but those of the first document is covered as far as they reach.
3. Per anchor the surroundings are ordered to the right and, reversed, to the left by a deep-shallow
   sort: multikey quicksort on the first ``SHALLOW`` bytes, then a blind trie for each group that is still
   equal. The common prefix lengths of neighbours give those of all pairs, and a pair of which left and right
   reach ``length`` bytes together marks its bytes in the later document. Anchors of at most ``group`` places are
   compared place by place; of the others, equal surroundings are one with their smallest document.
4. Anchors with more than ``group`` distinct surroundings (both ends of a passage that a large part of the
   corpus holds) are spelled out into their strings instead, whose first documents a plain aggregation finds.

So no task holds an unbounded group, and no pair of documents is listed.

Edge cases: null is empty. Texts under ``length`` bytes lose nothing. Rows that share a doc_id are one document
of several texts: none of them is earlier than another. A null doc_id comes before all others. Repeated rows
each get a row. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import KEY, join_measured
from weekloom.llm.words import INVERSE, as_bytes, group_cuts, mix, passes, powers, prefix_sums, whole_groups
from weekloom.session import stage

LENGTH = 50
GRAM = 20
SHALLOW = 8
GROUP = 256
#: A bit map of anchors has 2**27 bits, 16 MB.
MAP_BITS = 27
FIRST = -(2**63)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    if len(data) < size:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(data)
    with np.errstate(over="ignore"):
        return mix((sums[size:] - sums[:-size]) * powers(INVERSE, len(sums))[: len(data) - size + 1])


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every window of ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        add = min(have, width - have)
        out, have = pick(out[:-add], out[add:]), have + add
    return out


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of one text that some string of ``length`` bytes names, their hashes, and the hash each string names."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = gram_hashes(data, GRAM)
    w = length - GRAM + 1
    low = sliding(h, w, np.minimum)
    pad = np.zeros(w - 1, np.uint64)
    named = sliding(np.concatenate([pad, low, pad]), w, np.maximum) == h
    at = np.flatnonzero(named)
    return at, h[at], low


def named_by(at: np.ndarray, h: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the first and the last string that name each anchor. Those between do too: no smaller hash stands
    between the anchor and either end."""
    first, last = np.zeros_like(at), np.zeros_like(at)
    for k in range(0, len(at), 16384):
        part = slice(k, k + 16384)
        start = at[part, None] - np.arange(width)
        hit = (low[np.clip(start, 0, len(low) - 1)] == h[part, None]) & (start >= 0) & (start < len(low))
        last[part] = at[part] - hit.argmax(axis=1)
        first[part] = at[part] - (width - 1 - hit[:, ::-1].argmax(axis=1))
    return first, last


def longer(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """32 bits of every anchor with half the spare bytes of a string before it, and behind it.

    Where the text has not that many bytes on one side, the other side stands for it; on neither side means that
    no string of ``length`` bytes fits, which ``anchors`` rules out.
    """
    half = (length - GRAM + 1) // 2
    g = short(gram_hashes(data, GRAM + half))
    has_left, has_right = at >= half, at < len(g)
    before, behind = np.where(has_left, at - half, at), np.where(has_right, at, at - half)
    return g[before], g[behind]


def _seen(batches: Iterator[pa.RecordBatch], length: int, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(``_g``, ``_n``): 32 bits of every anchor, or of both longer forms of those that ``bits`` knows, and how many
    texts of a slice have it."""

    def codes(data: np.ndarray) -> np.ndarray:
        at, h, _ = anchors(data, length)
        return short(h) if bits is None else np.concatenate(longer(data, at[known(bits, short(h))], length))

    for batch in batches:
        for _, part in passes(batch.column("_text")):
            found = np.concatenate([np.unique(codes(np.frombuffer(t, np.uint8))) for t in part])
            g, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n.astype(np.int32))], names=["_g", "_n"])


def short(h: np.ndarray) -> np.ndarray:
    """32 bits; mixed once more, as anchors are minima and their high bits are mostly zero."""
    return (mix(h + np.uint64(1)) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def slot(g: np.ndarray) -> np.ndarray:
    """Place of an anchor in the bit map."""
    return (g.view(np.uint32) >> np.uint32(32 - MAP_BITS)).astype(np.int64)


def is_set(bits: np.ndarray, s: np.ndarray) -> np.ndarray:
    return ((bits[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def known(bits: np.ndarray, g: np.ndarray) -> np.ndarray:
    return is_set(bits, slot(g))


def shared(seen: DataFrame) -> DataFrame:
    """Places in the bit map of what stands in two texts."""
    found = seen.groupBy("_g").agg(F.sum("_n").alias("_texts")).where("_texts > 1")
    return found.select(F.shiftrightunsigned("_g", 32 - MAP_BITS).alias("_slot"))


def bit_map(slots: DataFrame) -> np.ndarray:
    """Bits of ``_slot``: a filter of fixed size, whatever the corpus. What it lets through by chance, or as texts of
    one document, is sorted out by the exact steps behind it."""
    rows = (
        slots.groupBy(F.shiftrightunsigned("_slot", 6).alias("_word"))
        .agg(F.expr("bit_or(shiftleft(1L, _slot & 63))").alias("_bits"))
        .toArrow()
    )
    words = np.zeros(2 ** (MAP_BITS - 6), np.int64)
    words[rows.column("_word").to_numpy()] = rows.column("_bits").to_numpy()
    return words.view(np.uint64)


def _around(
    batches: Iterator[pa.RecordBatch], length: int, bits: np.ndarray, far: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """Every place of an anchor that both bit maps know, with the bytes of the strings that name it."""
    for batch in batches:
        docs, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_d", "_t"))
        for at, part in passes(batch.column("_text")):
            hs, ds, ts, ps, ctx = [], [], [], [], []
            for k, t in enumerate(part):
                data = np.frombuffer(t, np.uint8)
                place, h, low = anchors(data, length)
                keep = known(bits, short(h))
                place, h = place[keep], h[keep]
                before, behind = longer(data, place, length)
                keep = known(far, before) | known(far, behind)
                place, h = place[keep], h[keep]
                first, last = named_by(place, h, low, length - GRAM + 1)
                # The first byte says how many bytes stand before the anchor.
                ctx += [bytes((p - a,)) + t[a : b + length] for p, a, b in zip(place.tolist(), first.tolist(), last.tolist())]
                hs.append(h)
                ps.append(place)
                ds.append(np.full(len(h), docs[at + k]))
                ts.append(np.full(len(h), keys[at + k]))
            if ctx:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(hs).astype(np.int64)),
                        pa.array(np.concatenate(ds)),
                        pa.array(np.concatenate(ts)),
                        pa.array(np.concatenate(ps).astype(np.int32)),
                        pa.array(ctx, pa.binary()),
                    ],
                    names=["_h", "_d", "_t", "_at", "_ctx"],
                )


def _needed(batches: Iterator[pa.RecordBatch], mixed: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Places without surroundings where their anchor has the same everywhere."""
    for batch in batches:
        s = batch.column("_h").to_numpy() & (2**MAP_BITS - 1)
        ctx = batch.column("_ctx")
        ctx = pc.if_else(pa.array(is_set(mixed, s)), ctx, pa.scalar(None, ctx.type))
        yield batch.set_column(batch.schema.get_field_index("_ctx"), "_ctx", ctx)


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


class BlindTrie:
    """Orders distinct strings that share a long prefix: inner nodes keep a depth and next bytes only.

    An insertion walks down blindly to any leaf, compares with that one string, and branches where they differ.
    """

    def __init__(self, first: int) -> None:
        self.root: int | tuple[int, dict] = first

    def insert(self, x: int, text: list[bytes]) -> None:
        byte = lambda s, k: s[k] if k < len(s) else -1
        s, node = text[x], self.root
        while isinstance(node, tuple):
            key = byte(s, node[0])
            node = node[1][key] if key in node[1] else next(iter(node[1].values()))
        at = common_prefix(s, text[node])
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < at:
            above, via = node, byte(s, node[0])
            node = above[1][via]
        if isinstance(node, tuple) and node[0] == at:
            node[1][byte(s, at)] = x
            return
        new = (at, {byte(text[leaf(node)], at): node, byte(s, at): x})
        if above is None:
            self.root = new
        else:
            above[1][via] = new

    def order(self) -> list[int]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo += [node[1][k] for k in sorted(node[1], reverse=True)]
            else:
                out.append(node)
        return out


def leaf(node) -> int:
    while isinstance(node, tuple):
        node = next(iter(node[1].values()))
    return node


def multikey(rows: list[int], text: list[bytes], depth: int, limit: int, out: list[list[int]]) -> None:
    """Ternary quicksort by one byte after the other up to ``limit``; groups still equal there stay together."""
    while True:
        if len(rows) < 2 or depth >= limit:
            if rows:
                out.append(rows)
            return
        byte = lambda x: text[x][depth] if depth < len(text[x]) else -1
        pivot = byte(rows[len(rows) // 2])
        low, same, high = [], [], []
        for x in rows:
            b = byte(x)
            (same if b == pivot else low if b < pivot else high).append(x)
        multikey(low, text, depth, limit, out)
        if pivot < 0:
            out.extend([x] for x in same)
        else:
            multikey(same, text, depth + 1, limit, out)
        rows = high


def deep_shallow(text: list[bytes]) -> list[int]:
    """The order of the strings."""
    groups: list[list[int]] = []
    multikey(list(range(len(text))), text, 0, SHALLOW, groups)
    order: list[int] = []
    for g in groups:
        if len(g) > 1:
            trie = BlindTrie(g[0])
            for x in g[1:]:
                trie.insert(x, text)
            g = trie.order()
        order += g
    return order


def all_prefixes(text: list[bytes]) -> np.ndarray:
    """Common prefix length of every pair: running minima over neighbours in sorted order."""
    number = {t: k for k, t in enumerate(dict.fromkeys(text))}
    distinct = list(number)
    m = len(distinct)
    out = np.zeros((m, m), np.int64)
    if m > 1:
        order = deep_shallow(distinct)
        near = np.array([common_prefix(distinct[a], distinct[b]) for a, b in zip(order, order[1:])], np.int64)
        for i in range(m - 1):
            out[order[i], order[i + 1 :]] = np.minimum.accumulate(near[i:])
        out = np.maximum(out, out.T)
    np.fill_diagonal(out, [len(t) for t in distinct])
    at = np.array([number[t] for t in text])
    return out[at[:, None], at[None, :]]


def reach(ctx: list[bytes], first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Per surrounding the bytes before and after its anchor that earlier documents cover (0, 0: none)."""
    cut = [c[0] + 1 for c in ctx]
    right = all_prefixes([c[k:] for c, k in zip(ctx, cut)])
    left = all_prefixes([c[1:k][::-1] for c, k in zip(ctx, cut)])
    good = (left + right >= length) & (first[None, :] < first[:, None])
    return np.where(good, left, 0).max(axis=1), np.where(good, right, 0).max(axis=1)


def _reach(batches: Iterator[pa.RecordBatch], length: int, doc: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns ``keep`` of every surrounding with its reach, also of those that no other one of an earlier ``doc`` covers.

    Without ``_ctx`` an anchor's surroundings are the same, and reach as far as ``_left`` and ``_right`` say.
    """
    for part in whole_groups(batches, "_h"):
        h, first = part.column("_h").to_numpy(), part.column(doc).to_numpy()
        ctx = part.column("_ctx").to_pylist()
        left, right = np.zeros(len(h), np.int32), np.zeros(len(h), np.int32)
        cuts = group_cuts(h)
        if "_left" in part.column_names:
            later = first > np.repeat(np.minimum.reduceat(first, cuts[:-1]), np.diff(cuts))
            left, right = (np.where(later, part.column(c).to_numpy(), 0).astype(np.int32) for c in ("_left", "_right"))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if hi - lo > 1 and ctx[lo] is not None:
                left[lo:hi], right[lo:hi] = reach(ctx[lo:hi], first[lo:hi], length)
        yield pa.RecordBatch.from_arrays(
            [*(part.column(c).combine_chunks() for c in keep), pa.array(left), pa.array(right)],
            names=[*keep, "_left", "_right"],
        )


def spelled_out(large: DataFrame, length: int) -> DataFrame:
    """Reach of the surroundings of anchors with very many of them, string by string."""
    before = F.ascii(F.substring("_ctx", 1, 1).cast("string"))
    body = F.substring(F.col("_ctx"), F.lit(2), F.length("_ctx"))
    n = F.length("_ctx") - 1
    df = large.withColumn("_before", before).withColumn("_body", body).withColumn("_n", n).where(n >= length)
    strings = df.select("_no", "_h", "_first", "_before", F.explode(F.sequence(F.lit(0), F.col("_n") - length)).alias("_i"), "_body")
    off = F.col("_before") - F.col("_i")
    text = F.substring(F.col("_body"), F.col("_i") + 1, F.lit(length))
    # 128 bits name the anchor, its place in the string and the string.
    named = strings.select(*(F.xxhash64(F.lit(k), "_h", off, text).alias(f"_s{k}") for k in (1, 2)), "_no", "_first", off.alias("_off"))
    earliest = named.groupBy("_s1", "_s2").agg(F.min("_first").alias("_earliest"), F.max("_first").alias("_latest"))
    # Strings of several documents are few beside those that run out of a common passage into a text of its own.
    several = stage(earliest.where("_earliest < _latest").drop("_latest"), "strings-of-several")
    hit = join_measured(named, several, ["_s1", "_s2"], "inner", 64).where("_earliest < _first")
    return hit.groupBy("_no").agg(
        F.max("_off").cast("int").alias("_left"), F.max(F.lit(length) - F.col("_off")).cast("int").alias("_right")
    )


def covered(texts: DataFrame, length: int, group: int) -> DataFrame:
    """(``_d``, ``_at``, ``_left``, ``_right``): anchors and how far around them earlier documents reach.

    ``texts``: ``_d``, ``_t`` (hash of the text) and ``_text``.
    """
    slim = texts.select("_d", "_t", "_text")
    only = slim.select("_text")
    send = texts.sparkSession.sparkContext.broadcast
    bits = send(bit_map(shared(only.mapInArrow(lambda b: _seen(b, length, None), "_g int, _n int"))))
    far = send(bit_map(shared(only.mapInArrow(lambda b: _seen(b, length, bits.value), "_g int, _n int"))))
    every = slim.mapInArrow(lambda b: _around(b, length, bits.value, far.value), "_h bigint, _d bigint, _t bigint, _at int, _ctx binary")
    # Surroundings travel as bytes; their keys are made from them where a join wants them.
    code = [F.xxhash64(F.lit(s), "_h", "_ctx").alias(f"_k{s}") for s in (1, 2)]
    places = stage(every, "places")
    # An anchor of few places meets in one task as it is; copies among its surroundings only matter where it has many.
    ctx = F.xxhash64("_ctx")
    kinds = places.groupBy("_h").agg(F.count(F.lit(1)).alias("_size"), (F.min(ctx) < F.max(ctx)).alias("_mixed"))
    kinds = stage(kinds.where(F.col("_mixed") | (F.col("_size") > group)), "anchor-kinds")
    frequent = kinds.where(F.col("_size") > group).select("_h")
    slots = kinds.where(F.col("_size") <= group).select(F.col("_h").bitwiseAND(F.lit(2**MAP_BITS - 1)).alias("_slot"))
    mixed = send(bit_map(slots))
    before = F.ascii(F.substring("_ctx", 1, 1).cast("string"))
    direct = (
        join_measured(places, frequent, ["_h"], "left_anti", 64)
        .select("*", before.alias("_left"), (F.length("_ctx") - 1 - before).alias("_right"))
        .mapInArrow(
            lambda b: _needed(b, mixed.value), "_h bigint, _d bigint, _t bigint, _at int, _ctx binary, _left int, _right int"
        )
        .repartition("_h")
        .sortWithinPartitions("_h")
        .mapInArrow(lambda b: _reach(b, length, "_d", ["_d", "_t", "_at"]), "_d bigint, _t bigint, _at int, _left int, _right int")
    )
    places = stage(join_measured(places, frequent, ["_h"], "inner", 64), "frequent-places")
    distinct = stage(places.groupBy("_h", "_ctx").agg(F.min("_d").alias("_first")), "surroundings")
    sizes = distinct.groupBy("_h").agg(F.count(F.lit(1)).alias("_size"))
    large = stage(sizes.where(F.col("_size") > group).select("_h"), "large")
    compared = (
        join_measured(distinct, large, ["_h"], "left_anti", 64)
        .repartition("_h")
        .sortWithinPartitions("_h")
        .select("_h", "_first", "_ctx")
        .mapInArrow(
            lambda b: _reach(b, length, "_first", ["_h", "_ctx", "_first"]), "_h bigint, _ctx binary, _first bigint, _left int, _right int"
        )
        .select(*code, "_first", "_left", "_right")
    )
    often = join_measured(distinct, large, ["_h"], "inner", 64).withColumn("_no", F.monotonically_increasing_id())
    often = stage(often.select("_no", "_h", "_ctx", "_first"), "often")
    often = often.select("_no", *code, "_first").join(spelled_out(often, length), "_no", "left")
    reached = compared.union(often.select(*KEY, "_first", "_left", "_right"))
    size = F.least(F.lit(length), F.length("_ctx") - 1 - F.ascii(F.substring("_ctx", 1, 1).cast("string")))
    # A later document with the same surroundings is covered as far as they hold a whole string.
    whole = F.when(F.length("_ctx") > length, F.struct(F.ascii(F.substring("_ctx", 1, 1).cast("string")).alias("l"), size.alias("r")))
    repeated = (
        places.select(*code, "_d", "_t", "_at", whole.alias("_whole"))
        .join(reached, KEY)
        .select(
            "_d",
            "_t",
            "_at",
            F.when(F.col("_d") > F.col("_first"), F.col("_whole.l")).otherwise(F.col("_left")).alias("_left"),
            F.when(F.col("_d") > F.col("_first"), F.col("_whole.r")).otherwise(F.col("_right")).alias("_right"),
        )
    )
    return direct.union(repeated).where("_right > 0")


def _digest(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        copy = batch.column("_copy").to_pylist()
        spans = batch.column("_spans").to_pylist()
        rows = []
        for k, t in enumerate(as_bytes(batch.column("_text"))):
            t = t or b""
            if copy[k] and len(t) >= length:
                rows.append((len(t), len(t), 1, hashlib.sha256(b"").hexdigest()))
                continue
            kept, at, removed, runs = [], 0, 0, 0
            for s in spans[k] or []:
                kept.append(t[at : s["a"]])
                at, removed, runs = s["b"], removed + s["b"] - s["a"], runs + 1
            kept.append(t[at:])
            rows.append((len(t), removed, runs, hashlib.sha256(b"".join(kept)).hexdigest()))
        n, removed, runs, sha = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, runs)), pa.array(sha, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans in order, those that touch as one."""
    for batch in batches:
        spans = batch.column("_spans")
        cut = spans.offsets.to_numpy()
        a, b = (spans.values.field(c).to_numpy()[cut[0] : cut[-1]].astype(np.int64) for c in "ab")
        # A row's spans lie behind those of the rows before it.
        base = np.repeat(np.arange(len(spans), dtype=np.int64) << 32, np.diff(cut))
        order = np.argsort(base + a, kind="stable")
        a, b = (base + a)[order], np.maximum.accumulate((base + b)[order])
        first = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]])[: len(a)])
        last = np.append(first[1:], len(a))[: len(first)] - 1
        a, b = (pa.array((x & 0xFFFFFFFF).astype(np.int32)) for x in (a[first], b[last]))
        rows = np.searchsorted(base[order][first], np.arange(len(spans) + 1, dtype=np.int64) << 32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("_d"),
                batch.column("_t"),
                pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.StructArray.from_arrays([a, b], names=["a", "b"])),
            ],
            names=["_d", "_t", "_spans"],
        )


def removed(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Per document its bytes, those that go, in how many runs, and the hash of the rest."""
    code = [F.xxhash64(F.lit(s), F.coalesce("text", F.lit(""))).alias(f"_k{s}") for s in (1, 2)]
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(FIRST)).alias("_d"), F.col("text").alias("_text"), *code)
    long = F.octet_length("_text") >= length
    firsts = rows.where(long).groupBy(*KEY).agg(F.min("_d").alias("_first"), F.count(F.lit(1)).alias("_n"))
    copies = stage(firsts.where("_n > 1").select(*KEY, "_first"), "copies")
    known = join_measured(rows, copies, KEY, "left", 64).withColumn("_copy", F.coalesce(F.col("_d") > F.col("_first"), F.lit(False)))
    # The hash of a text tells it from others under its id, where there are any.
    several = not rows.groupBy("_d").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty()
    name = F.col("_k1") if several else F.lit(0).cast("long")
    alone = known.where(~F.col("_copy") & long).withColumn("_t", name)
    found = covered(alone, length, group)
    spans = found.groupBy("_d", "_t").agg(
        F.collect_set(F.struct((F.col("_at") - F.col("_left")).alias("a"), (F.col("_at") + F.col("_right")).alias("b"))).alias("_spans")
    )
    spans = stage(spans.mapInArrow(_merged, "_d bigint, _t bigint, _spans array<struct<a:int,b:int>>"), "spans")
    out = join_measured(known.withColumn("_t", name), spans, ["_d", "_t"], "left", 80 + 16 * F.size("_spans"))
    kind = dict(docs.dtypes)["doc_id"]
    return out.select("doc_id", "_text", "_copy", F.when(~F.col("_copy"), F.col("_spans")).alias("_spans")).mapInArrow(
        lambda b: _digest(b, length), f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )
