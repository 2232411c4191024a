"""Substring dedup: near-duplicate passages by compact windows.

1. A text is a sequence of word shingles. They are dealt out once by the first bits of their hashes, packed, and
   meet there: of each text the shingles go on that another text holds, each with its place and the number of
   earlier texts that hold it. No others can be shared; texts themselves do not travel.
2. For each of ``hashes`` hash functions a Cartesian tree over the hashes of these shingles (its smallest hash at
   the root, the same on either side) yields compact windows: all subsequences that contain the root and stay
   inside its subtree share that min-hash. Only subtrees that can hold a passage of ``words`` words are kept, so a
   text has windows in proportion to its length over ``words``.
3. Windows of one hash function with the same min-hash meet. They are sorted by (min-hash, document) over range
   partitions, so a min-hash that a third of the corpus holds is spread over many tasks, and streamed: each
   window is linked to the earliest document of its min-hash and to the one before its own, so a chain of n
   holders costs at most 2n links. The windows of a min-hash that began in an earlier range get their links across
   the border from the holders at the ends of the ranges, a row or two per range, which every task is sent. Where
   the windows of two documents meet, the sweep over the intervals gives the stretches that ``agree`` or more hash
   functions cover; each stretch is verified on the shingles of both texts: a passage of ``words`` words or more
   whose shingles are ``percent`` per cent the earlier text's.
4. The chains leave out pairs, so what they can have missed is settled exactly. A passage with one earlier text is a
   passage too if the shingles of all earlier texts count; such stretches with words in no passage yet are open. Of
   an open stretch as many shingles as possible are set aside, those with most earlier holders first, as long as
   they alone make no passage with an open word: any earlier text that covers an open word holds one of the others.
   The holders of these are looked up and verified, the earliest first and then sixteen times as many in each round,
   until no stretch is open or none has a holder left. So every word that is in a passage with any earlier text
   is in one of the passages found, whatever the min-hashes say; of equally good holders not all are listed.

Exact copies of a text are found first and searched once.

Edge cases: null, empty and short texts have no passage. Exact copies are passages as a whole. Rows that share
a doc_id count as one document, and a null doc_id as the first. Repeated rows each get a row. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.llm.common import KEY, join_measured, numbered
from weekloom.llm.words import NOT_SPACE, Words, group_cuts, mix, passes, whole_groups
from weekloom.session import stage

FIRST = -(2**63)
SPANS = "array<struct<first:int,last:int,other:bigint>>"
#: Rows of the streamed chains: a link, a window of a range's first min-hash, holders of a range's last min-hash.
LINK, HEAD, TAIL = 0, 1, 2
CHAIN = "_v bigint, _d bigint, _row bigint, _at bigint, _e bigint, _e_row bigint, _kind tinyint, _range int"
#: Shingles that a task deals out at once, and those of a range of hashes, about, that meet in one group.
DEALT, MET = 1_000_000, 1_000_000
#: Holders looked up in a round, times those up to the round before.
GROWTH = 16
PIECE = "_row bigint, _piece int, _d bigint, _at binary, _code binary, _nth binary, _covered binary, _need array<struct<code:bigint,upto:int>>"


@dataclass(frozen=True)
class Passages:
    shingle: int = 5
    words: int = 50
    percent: int = 80
    hashes: int = 4
    agree: int = 2

    @property
    def least(self) -> int:
        """Shared shingles of the shortest passage."""
        return -(-self.percent * (self.words - self.shingle + 1) // 100)


def sequence(w: Words, first: int, last: int, size: int) -> np.ndarray:
    """Shingle hashes in text order."""
    h = w.hash[first:last]
    if len(h) < size:
        return h[:0]
    with np.errstate(over="ignore"):
        code = np.zeros(len(h) - size + 1, np.uint64)
        for k in range(size):
            code = mix(code * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k])
    return code


def compact_windows(values: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(left, root, right) of the nodes of the Cartesian tree whose subtree is ``width`` or wider.

    The tree is grown from its root by range minima, never below ``width``.
    """
    n = len(values)
    if n < width:
        return []
    # Sparse table of positions of minima; ties go to the left.
    table = [np.arange(n)]
    span = 1
    while 2 * span <= n:
        a, b = table[-1][:-span], table[-1][span:]
        table.append(np.where(values[b] < values[a], b, a))
        span *= 2
    out, todo = [], [(0, n)]
    while todo:
        lo, hi = todo.pop()
        k = (hi - lo).bit_length() - 1
        a, b = int(table[k][lo]), int(table[k][hi - (1 << k)])
        root = b if values[b] < values[a] else a
        out.append((lo, root, hi - 1))
        if root - lo >= width:
            todo.append((lo, root))
        if hi - root - 1 >= width:
            todo.append((root + 1, hi))
    return out


def planes(a: np.ndarray) -> bytes:
    """Numbers as bytes, all first bytes first: what is small or in order compresses."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def numbers(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _dealt(batches: Iterator[pa.RecordBatch], cfg: Passages, bits: int) -> Iterator[pa.RecordBatch]:
    """Shingles by the first ``bits`` bits of their hash, the next 32 of each packed with its text and its place.

    A run is what one text has in one range: the places in it are differences.
    """

    def packed(codes, rows, sizes):
        code, size = np.concatenate(codes), np.array(sizes)
        row = np.repeat(np.array(rows), size)
        at = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
        part = (code >> np.uint64(64 - bits)).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        part, row, at = part[order], row[order], at[order]
        h = (code[order] >> np.uint64(32 - bits)).astype(np.uint32)
        starts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (part[1:] != part[:-1])]))
        step = np.diff(at, prepend=0)
        step[starts] = at[starts]
        runs, step = np.diff(starts, append=len(code)).astype(np.uint32), step.astype(np.uint32)
        cut = group_cuts(part)
        run_cut = np.searchsorted(starts, cut)
        spans, run_spans = [*zip(cut, cut[1:])], [*zip(run_cut, run_cut[1:])]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(part[cut[:-1]].astype(np.int32)),
                pa.array([h[a:b].tobytes() for a, b in spans], pa.binary()),
                pa.array([planes(step[a:b]) for a, b in spans], pa.binary()),
                pa.array([planes(row[starts[a:b]]) for a, b in run_spans], pa.binary()),
                pa.array([planes(runs[a:b]) for a, b in run_spans], pa.binary()),
            ],
            names=["_part", "_h", "_step", "_rows", "_runs"],
        )

    held: list[tuple] = []
    size = 0
    for batch in batches:
        ids = batch.column("_row").to_numpy()
        for at, part in passes(batch.column("_text")):
            w = Words(part, NOT_SPACE)
            for k in range(len(part)):
                seq = sequence(w, w.cut[k], w.cut[k + 1], cfg.shingle)
                if len(seq):
                    held.append((seq, ids[at + k], len(seq)))
                    size += len(seq)
            if size >= DEALT:
                yield packed(*zip(*held))
                held, size = [], 0
    if held:
        yield packed(*zip(*held))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that two texts or more hold: text, place, code and how many earlier texts hold it."""
    for table in whole_groups(batches, "_part"):
        parts = table.column("_part").to_numpy()
        cut = group_cuts(parts)
        for a, b in zip(cut, cut[1:]):
            columns = {c: table.column(c).slice(a, b - a).to_pylist() for c in ("_h", "_step", "_rows", "_runs")}
            h = np.frombuffer(b"".join(columns["_h"]), np.uint32)
            step = np.concatenate([numbers(x, np.uint32) for x in columns["_step"]]).astype(np.int64)
            texts, which = np.unique(np.concatenate([numbers(x, np.int64) for x in columns["_rows"]]), return_inverse=True)
            runs = np.concatenate([numbers(x, np.uint32) for x in columns["_runs"]]).astype(np.int64)
            starts = np.cumsum(runs) - runs
            upto = np.cumsum(step)
            at = upto - np.repeat(upto[starts] - step[starts], runs)
            # Rows are in order of the documents, so are the holders of a code.
            key = h.astype(np.uint64) << np.uint64(32) | np.repeat(which, runs).astype(np.uint64)
            order = np.argsort(key)
            key = key[order]
            code, text = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
            first = np.concatenate([[True], code[1:] != code[:-1]])
            holder = np.cumsum(first | np.concatenate([[True], text[1:] != text[:-1]]))
            begin = np.flatnonzero(first)
            group = np.cumsum(first) - 1
            n = holder[np.append(begin[1:], len(code)) - 1] - holder[begin]
            keep = np.flatnonzero(n[group] > 0)
            if len(keep):
                nth = (holder - holder[begin][group])[keep]
                columns = (texts[text[keep]], at[order][keep].astype(np.int32), int(parts[a]) << 32 | code[keep], nth.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["_row", "_at", "_code", "_nth"])


def held_before(at: np.ndarray, nth: np.ndarray, cfg: Passages) -> list[tuple[int, int]]:
    """The passages if the shingles of all earlier texts count: no passage lies outside of them."""
    if np.count_nonzero(nth) < cfg.least:
        return []
    flags = np.zeros(at[-1] + 1, bool)
    flags[at[nth > 0]] = True
    return passages(flags, cfg)


def _texts(batches: Iterator[pa.RecordBatch], cfg: Passages) -> Iterator[pa.RecordBatch]:
    """A row per text from its shingles in order: places, codes, numbers of earlier holders; whether it may hold a passage."""
    for table in whole_groups(batches, "_row"):
        row, at, code, nth = (table.column(c).to_numpy() for c in ("_row", "_at", "_code", "_nth"))
        cut = group_cuts(row)
        spans = [*zip(cut, cut[1:])]
        packed = ([planes(x[a:b]) for a, b in spans] for x in (at, code, nth))
        may = [bool(held_before(at[a:b], nth[a:b], cfg)) for a, b in spans]
        yield pa.RecordBatch.from_arrays(
            [pa.array(row[cut[:-1]]), *(pa.array(x, pa.binary()) for x in packed), pa.array(may, pa.bool_())],
            names=["_row", "_at", "_code", "_nth", "_may"],
        )


def shared(rows: DataFrame, shingles: int, cfg: Passages) -> DataFrame:
    """Per text the shingles that another text holds, in order."""
    bits = min(16, max(6, (shingles // MET).bit_length()))
    dealt = rows.select("_row", "_text").mapInArrow(
        lambda b: _dealt(b, cfg, bits), "_part int, _h binary, _step binary, _rows binary, _runs binary"
    )
    # As many partitions as ranges of hashes: a task's share does not grow with the input.
    met = dealt.repartition(2**bits, "_part").sortWithinPartitions("_part").mapInArrow(_met, "_row bigint, _at int, _code bigint, _nth int")
    return met.repartition("_row").sortWithinPartitions("_row", "_at").mapInArrow(
        lambda b: _texts(b, cfg), "_row bigint, _at binary, _code binary, _nth binary, _may boolean"
    )


def _windows(batches: Iterator[pa.RecordBatch], cfg: Passages) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, docs = (batch.column(c).to_numpy() for c in ("_row", "_d"))
        out: list[tuple] = []
        for k, (at, code) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_at", "_code")))):
            at, code = numbers(at, np.int32).astype(np.int64), numbers(code, np.uint64)
            if len(at) < cfg.least:
                continue
            for f in range(cfg.hashes):
                with np.errstate(over="ignore"):
                    values = mix(code + np.uint64(f + 1) * np.uint64(0x9E3779B97F4A7C15))
                found = np.array(compact_windows(values, cfg.least), np.int64).reshape(-1, 3)
                # The remainder by ``hashes`` names the hash function.
                v = values[found[:, 1]]
                v = v - v % np.uint64(cfg.hashes) + np.uint64(f)
                both = (np.full(len(v), x[k], np.int64) for x in (docs, rows))
                out.append((v.view(np.int64), *both, at[found[:, 0]] << 32 | at[found[:, 2]]))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c)) for c in zip(*out)], names=["_v", "_d", "_row", "_at"]
            )


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows in order of (min-hash, document) to links with the first and the previous document of the min-hash."""
    here = TaskContext.get().partitionId()

    def rows(kind, v, d, row, at, e, e_row):
        n = len(v)
        return pa.RecordBatch.from_arrays(
            [
                *(pa.array(c) for c in (v, d, row, at)),
                *(c if isinstance(c, pa.Array) else pa.array(c) for c in (e, e_row)),
                pa.array(np.full(n, kind, np.int8)),
                pa.array(np.full(n, here, np.int32)),
            ],
            names=["_v", "_d", "_row", "_at", "_e", "_e_row", "_kind", "_range"],
        )

    head, last_v, state = None, None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        v, d, row, at = (batch.column(c).to_numpy() for c in ("_v", "_d", "_row", "_at"))
        head = v[0] if head is None else head
        # The holders that the rows so far leave behind stand before the batch: first, previous, last.
        old = state if last_v == v[0] else []
        k = len(old)
        if k:
            v = np.concatenate([np.full(k, last_v), v])
            d = np.concatenate([np.array([x[0] for x in old]), d])
            row = np.concatenate([np.array([x[1] for x in old]), row])
            at = np.concatenate([np.zeros(k, np.int64), at])
        i = np.arange(len(v))
        new_v = np.concatenate([[True], v[1:] != v[:-1]])
        new_d = new_v | np.concatenate([[True], d[1:] != d[:-1]])
        first, own = (np.maximum.accumulate(np.where(x, i, 0)) for x in (new_v, new_d))
        later = (own > first) & (i >= k)
        before = np.maximum(own - 1, 0)
        for to, mine in ((first, later), (before, later & (row[before] != row[first]))):
            m = np.flatnonzero(mine)
            if len(m):
                yield rows(LINK, v[m], d[m], row[m], at[m], d[to[m]], row[to[m]])
        m = np.flatnonzero((v == head) & (i >= k))
        if len(m):
            e, e_row = (pa.array(x[before[m]], mask=own[m] <= first[m]) for x in (d, row))
            yield rows(HEAD, v[m], d[m], row[m], at[m], e, e_row)
        z = len(v) - 1
        last_v = v[z]
        state = [(d[j], row[j]) for j in (first[z], *([before[z]] if own[z] > first[z] else []), z)]
    if state:
        none = np.zeros(len(state), np.int64)
        d, row = (np.array(x, np.int64) for x in zip(*state))
        yield rows(TAIL, np.full(len(state), last_v), d, row, none, none, none)


def _settled(batches: Iterator[pa.RecordBatch], before: dict[tuple[int, int], tuple]) -> Iterator[pa.RecordBatch]:
    """The links of the ranges, and those of the windows of a range's first min-hash with its holders in earlier ranges."""
    names = ["_v", "_d", "_row", "_at", "_e", "_e_row"]
    for batch in batches:
        kind, v, d, ranges = (batch.column(c).to_numpy() for c in ("_kind", "_v", "_d", "_range"))
        yield batch.filter(pa.array(kind == LINK)).select(names)
        heads = np.flatnonzero(kind == HEAD)
        for one in np.unique(ranges[heads]).tolist():
            mine = heads[ranges[heads] == one]
            lo, hi = before.get((int(v[mine[0]]), one), (None, None))
            if lo is None:
                continue
            # Behind the border a window's previous document is the range's own, if there is one.
            alone = batch.column("_e").is_null().to_numpy(zero_copy_only=False)[mine]
            for (e, e_row), those in ((lo, mine), (hi, mine[alone] if hi != lo else mine[:0])):
                those = those[e < d[those]]
                columns = batch.take(pa.array(those)).select(names[:4]).columns
                to = (pa.array(np.full(len(those), x, np.int64)) for x in (e, e_row))
                yield pa.RecordBatch.from_arrays([*columns, *to], names=names)


def links(windows: DataFrame) -> DataFrame:
    """Each window with the first and the previous document of its min-hash, both earlier than its own."""
    order = ["_v", "_d", "_row"]
    chains = windows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_chains, CHAIN)
    chains = stage(chains, "window-chains")
    # One row per range that begins or ends with the min-hash: as many as there are ranges, twice at most.
    holder = F.when(F.col("_kind") == TAIL, F.struct("_d", "_row"))
    borders = chains.where(F.col("_kind") != LINK).groupBy("_v", "_range").agg(F.min(holder).alias("_lo"), F.max(holder).alias("_hi"))
    so_far = Window.partitionBy("_v").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    borders = borders.select("_v", "_range", F.min("_lo").over(so_far).alias("_lo"), F.max("_hi").over(so_far).alias("_hi"))
    before = {(r["_v"], r["_range"]): (r["_lo"], r["_hi"]) for r in borders.where(F.col("_lo").isNotNull()).collect()}
    before = windows.sparkSession.sparkContext.broadcast(before)
    return chains.where(F.col("_kind") != TAIL).mapInArrow(
        lambda b: _settled(b, before.value), "_v bigint, _d bigint, _row bigint, _at bigint, _e bigint, _e_row bigint"
    )


def stretches(lo: np.ndarray, hi: np.ndarray, agree: int) -> list[tuple[int, int]]:
    """Maximal ranges that at least ``agree`` intervals cover."""
    at = np.concatenate([lo, hi + 1])
    step = np.concatenate([np.ones(len(lo), np.int64), -np.ones(len(hi), np.int64)])
    order = np.lexsort((-step, at))
    depth = np.cumsum(step[order])
    out, start = [], None
    for x, d in zip(at[order], depth):
        if d >= agree and start is None:
            start = int(x)
        elif d < agree and start is not None:
            out.append((start, int(x) - 1))
            start = None
    return out


def passages(shared: np.ndarray, cfg: Passages) -> list[tuple[int, int]]:
    """Word ranges of whole passages, given for each shingle whether the other text has it.

    A passage begins and ends with a shared shingle, is ``words`` words or more, and ``percent`` per cent of its
    shingles are shared. Found are all that no larger passage contains: with ``sum`` the running excess of shared
    shingles over that share, a stretch is a passage if its ``sum`` does not fall, so each start takes the last end
    whose ``sum`` is not lower; the maxima from the right are in order, and a search finds it.
    """
    edge = np.diff(shared.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return []
    excess = np.concatenate([[0], np.cumsum(100 * shared.astype(np.int64) - cfg.percent)])
    best = np.maximum.accumulate(excess[ends][::-1])[::-1]
    # ``best`` falls from left to right: as many ends as are not lower than the start's sum.
    last = np.searchsorted(-best, -excess[starts], "right") - 1
    out: list[tuple[int, int]] = []
    reach = 0
    for lo, hi in zip(starts, ends[last]):
        if hi > reach and hi - lo + cfg.shingle - 1 >= cfg.words:
            out.append((int(lo), int(hi + cfg.shingle - 2)))
            reach = hi
    return out


def _agreed(batches: Iterator[pa.RecordBatch], cfg: Passages) -> Iterator[pa.RecordBatch]:
    """Pairs with the stretches that enough hash functions cover; others go."""
    least = cfg.percent * (cfg.words - cfg.shingle + 1)
    for batch in batches:
        keep, spans = [], []
        windows = batch.column("_w")
        cut, flat = windows.offsets.to_numpy(), windows.values
        kind, at = (flat.field(c).to_numpy() for c in ("_f", "_at"))
        for k in range(batch.num_rows):
            f, w = kind[cut[k] : cut[k + 1]], at[cut[k] : cut[k + 1]]
            lo, hi = [], []
            for mine in (w[f == one] for one in np.unique(f)):
                for a, b in stretches(mine >> 32, mine & 0xFFFFFFFF, 1):
                    lo.append(a)
                    hi.append(b)
            both = stretches(np.array(lo), np.array(hi), cfg.agree)
            # Too few shingles for the shared ones of the shortest passage.
            if 100 * sum(b - a + 1 for a, b in both) >= least:
                keep.append(k)
                spans.append([{"lo": a, "hi": b} for a, b in both])
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(pa.array(keep, pa.int64())) for c in ("_row", "_e", "_e_row")), pa.array(spans, kind)],
            names=["_row", "_e", "_e_row", "_near"],
        )


def _verify(batches: Iterator[pa.RecordBatch], cfg: Passages) -> Iterator[pa.RecordBatch]:
    """Passages of each pair of texts from its stretches and the shingles of both."""
    last, known = None, np.zeros(0, np.int64)
    for batch in batches:
        out: list[tuple[int, int, int, int]] = []
        columns = [batch.column(c).to_pylist() for c in ("_row", "_e", "_near", "_at", "_code", "_other_code")]
        for r, e, spans, at, mine, theirs in zip(*columns):
            # Pairs come in order of the other text: it is sorted once.
            if theirs != last:
                last, known = theirs, np.sort(numbers(theirs, np.int64))
            at, mine = numbers(at, np.int32), numbers(mine, np.int64)
            hit = known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine
            near = np.zeros(len(at), bool)
            for x in spans:
                near[slice(*np.searchsorted(at, [x["lo"], x["hi"] + 1]))] = True
            both = np.zeros(at[-1] - at[0] + 1, bool)
            both[at[hit & near] - at[0]] = True
            out += [(r, e, a + int(at[0]), b + int(at[0])) for a, b in passages(both, cfg)]
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["_row", "_e", "first", "last"]
            )


def to_look_up(at: np.ndarray, code: np.ndarray, nth: np.ndarray, covered: np.ndarray, cfg: Passages) -> np.ndarray | None:
    """Places in the stretch of the shingles of which an earlier text holds one if it covers an open word; None if none can.

    ``at`` counts from the first word of the stretch, ``covered`` tells which words are in a passage.
    """
    flags = np.zeros(at[-1] + 1, bool)

    def reached(those: np.ndarray) -> list[tuple[int, int]]:
        flags[:] = False
        flags[at[those]] = True
        return [(a, b) for a, b in passages(flags, cfg) if not covered[a : b + 1].all()]

    stretches_left = reached(np.ones(len(at), bool))
    if not stretches_left:
        return None
    codes, place, back = np.unique(code, return_index=True, return_inverse=True)
    rank = np.empty(len(codes), np.int64)
    rank[np.argsort(-nth[place].astype(np.int64), kind="stable")] = np.arange(len(codes))
    rank = rank[back]
    aside, most = 0, len(codes)
    while aside < most:
        middle = (aside + most + 1) // 2
        if reached(rank < middle):
            most = middle - 1
        else:
            aside = middle
    inside = np.zeros(len(at), bool)
    for a, b in stretches_left:
        inside |= (at >= a) & (at <= b)
    need = np.zeros(len(codes), bool)
    need[back[inside & (rank >= aside)]] = True
    return place[need]


def _pieces(batches: Iterator[pa.RecordBatch], cfg: Passages, seen: int) -> Iterator[pa.RecordBatch]:
    """Open stretches with what is to be looked up, of whole texts or of stretches that were open before.

    Those of which no shingle has more than ``seen`` earlier holders have been looked up entirely.
    """
    for batch in batches:
        again = "_piece" in batch.schema.names
        out: list[tuple] = []
        names = ["_row", "_d", "_at", "_code", "_nth", "_spans"] + (["_covered"] if again else [])
        for r, d, *packed, spans, old in zip(*(batch.column(c).to_pylist() for c in names), *([] if again else [[None] * len(batch)])):
            at, code, nth = (numbers(x, t) for x, t in zip(packed, (np.int32, np.int64, np.int32)))
            at, code, nth = (x[nth > 0] for x in (at, code, nth))
            whole = np.zeros(at[-1] + cfg.shingle, bool)
            if again:
                whole[at[0] :] = np.unpackbits(np.frombuffer(old, np.uint8), count=len(whole) - at[0])
            for x in spans or []:
                whole[x["first"] : x["last"] + 1] = True
            for a, b in held_before(at, nth, cfg):
                if whole[a : b + 1].all():
                    continue
                one = slice(*np.searchsorted(at, [a, b - cfg.shingle + 2]))
                covered = whole[a : b + 1]
                need = to_look_up(at[one] - a, code[one], nth[one], covered, cfg)
                need = need[nth[one][need] > seen]
                if len(need):
                    wanted = [{"code": c, "upto": n} for c, n in zip(code[one][need].tolist(), nth[one][need].tolist())]
                    out.append((r, a, d, *(planes(x[one]) for x in (at, code, nth)), np.packbits(covered).tobytes(), wanted))
        if out:
            kinds = (pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.list_(pa.struct([("code", pa.int64()), ("upto", pa.int32())])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                names=["_row", "_piece", "_d", "_at", "_code", "_nth", "_covered", "_need"],
            )


def _holders(batches: Iterator[pa.RecordBatch], low: int, high: int) -> Iterator[pa.RecordBatch]:
    """Texts by code, those with ``low`` up to ``high`` earlier holders of it."""
    for batch in batches:
        rows, out = batch.column("_row").to_numpy(), []
        for r, code, nth in zip(rows, *(batch.column(c).to_pylist() for c in ("_code", "_nth"))):
            code, nth = numbers(code, np.int64), numbers(nth, np.int32)
            code, place = np.unique(code[(low <= nth) & (nth < high)], return_index=True)
            out.append((code, nth[(low <= nth) & (nth < high)][place], np.full(len(code), r, np.int64)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["_code", "_nth", "_e_row"])


def spans_by_row(found: DataFrame) -> DataFrame:
    spans = F.sort_array(F.collect_set(F.struct("first", "last", F.col("_e").alias("other"))))
    return found.groupBy("_row").agg(spans.alias("_spans"))


def largest(found: DataFrame) -> DataFrame:
    """Without passages that a larger one with the same document contains, as open stretches that overlap give them."""
    before = Window.partitionBy("_row", "_e").orderBy("first", F.desc("last")).rowsBetween(Window.unboundedPreceding, -1)
    found = found.distinct().withColumn("_reach", F.max("last").over(before))
    return found.where(F.col("_reach").isNull() | (F.col("last") > F.col("_reach"))).drop("_reach")


def settled(texts: DataFrame, spans: DataFrame, cfg: Passages) -> list[DataFrame]:
    """What the links leave out: passages of all earlier texts that cover a word in no passage of ``spans``."""
    out: list[DataFrame] = []
    seen, left = 0, texts.where("_may").join(spans, "_row", "left")
    while True:
        pieces = stage(left.mapInArrow(lambda b, n=seen: _pieces(b, cfg, n), PIECE), "open-stretches")
        if pieces.isEmpty():
            return out
        upto = max(1, seen * GROWTH)
        need = stage(pieces.select("_row", "_piece", F.inline("_need")).withColumnRenamed("code", "_code"), "to-look-up")
        holders = texts.select("_row", "_code", "_nth").mapInArrow(
            lambda b, low=seen, high=upto: _holders(b, low, high), "_code bigint, _nth int, _e_row bigint"
        )
        pairs = join_measured(holders, need, ["_code"], "inner", 32).where(F.col("_nth") < F.col("upto"))
        pairs = pairs.select("_row", "_piece", "_e_row").distinct()
        mine = pairs.join(pieces.select("_row", "_piece", "_d", "_at", "_code"), ["_row", "_piece"])
        other = texts.select(F.col("_row").alias("_e_row"), F.col("_d").alias("_e"), F.col("_code").alias("_other_code"))
        both = mine.join(other, "_e_row").where(F.col("_e") < F.col("_d"))
        everywhere = F.array(F.struct(F.lit(0).alias("lo"), F.lit(2**31 - 2).alias("hi")))
        both = both.select("_row", "_e", everywhere.alias("_near"), "_at", "_code", "_other_code")
        found = both.mapInArrow(lambda b: _verify(b, cfg), "_row bigint, _e bigint, first int, last int")
        out.append(stage(found, "passages-settled"))
        seen, left = upto, pieces.drop("_need").join(spans_by_row(out[-1]), "_row", "left")


def find(docs: DataFrame, cfg: Passages = Passages()) -> DataFrame:
    """Per document its words, the words inside passages that an earlier document holds, and the passages."""
    code = [F.xxhash64(F.lit(s), F.coalesce("text", F.lit(""))).alias(f"_k{s}") for s in (1, 2)]
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    named = docs.select(
        "doc_id",
        F.coalesce("doc_id", F.lit(FIRST)).alias("_d"),
        words.cast("long").alias("n_words"),
        *code,
        F.octet_length("text").alias("_size"),
        F.col("text").alias("_text"),
    )
    # A row per text: its smallest id stands for all copies.
    slim = stage(named.drop("_text"), "passage-rows")
    texts = slim.groupBy(*KEY).agg(F.min("_d").alias("_first"), F.max("n_words").alias("_n_words"))
    # Rows are numbered in order of the documents.
    texts = numbered(texts.where(F.col("_n_words") >= cfg.words).orderBy("_first"), "texts")
    ids = F.col("_d") == F.col("_first")
    rows = join_measured(named.select("_d", *KEY, "_text"), texts, KEY, "inner", 100).where(ids)
    rows = rows.dropDuplicates(["_row"]) if not unique(slim) else rows
    shingles = texts.agg(F.sum("_n_words")).first()[0] or 0
    short = join_measured(shared(rows, shingles, cfg), texts.select("_row", F.col("_first").alias("_d")), ["_row"], "inner", 16)
    short = stage(short, "shared-shingles")
    windows = short.mapInArrow(lambda b: _windows(b, cfg), "_v bigint, _d bigint, _row bigint, _at bigint")
    # The hash function again, from the min-hash as an unsigned number.
    wrap = F.when(F.col("_v") < 0, F.lit(2**64 % cfg.hashes)).otherwise(F.lit(0))
    met = links(stage(windows, "windows")).withColumn("_f", F.pmod(F.pmod("_v", F.lit(cfg.hashes)) + wrap, F.lit(cfg.hashes)))
    # A group holds windows of one text. Most pairs met by chance, under one hash function.
    pairs = met.groupBy("_row", "_e", "_e_row").agg(F.collect_list(F.struct("_f", "_at")).alias("_w"))
    pairs = pairs.where(F.size(F.array_distinct("_w._f")) >= cfg.agree)
    pairs = pairs.mapInArrow(
        lambda b: _agreed(b, cfg), "_row bigint, _e bigint, _e_row bigint, _near array<struct<lo:int,hi:int>>"
    )
    pairs = stage(pairs, "window-pairs")
    mine = pairs.join(short.where("_may").select("_row", "_at", "_code"), "_row")
    both = mine.join(short.select(F.col("_row").alias("_e_row"), F.col("_code").alias("_other_code")), "_e_row")
    found = both.select(
        "_row", "_e", "_near", "_at", "_code", "_other_code"
    ).mapInArrow(lambda b: _verify(b, cfg), "_row bigint, _e bigint, first int, last int")
    found = stage(found, "passages-linked")
    for more in settled(short, spans_by_row(found), cfg):
        found = found.unionByName(more)
    spans = stage(spans_by_row(largest(found)), "passages-found").withColumn(
        "_upto", F.transform("_spans", lambda s, i: F.struct(s["first"].alias("first"), s["last"].alias("last")))
    )
    # Spans are in order of their first word: a word counts once, from behind all spans before it.
    grown = F.aggregate(
        "_upto",
        F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["last"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(a["end"], s["first"] - 1))).cast("long").alias("n"),
        ),
        lambda a: a["n"],
    )
    # Copies are one passage of the first; without one, the passages of their text.
    spans = stage(texts.join(spans, "_row", "left").select(*KEY, F.col("_first").alias("_of"), "_spans", grown.alias("_n")), "passages")
    out = join_measured(slim, spans, KEY, "left", 64 + 16 * F.size(F.coalesce("_spans", F.array().cast(SPANS))))
    copy = F.coalesce(F.col("_d") > F.col("_of"), F.lit(False))
    whole = F.array(F.struct(F.lit(0).alias("first"), (F.col("n_words") - 1).cast("int").alias("last"), F.col("_of").alias("other")))
    none = F.array().cast(SPANS)
    return out.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("_n", F.lit(0)).cast("long")).alias("n_dup_words"),
        F.when(copy, whole).otherwise(F.coalesce("_spans", none)).alias("passages"),
    ).withColumn("n_passages", F.size("passages").cast("long"))


def unique(slim: DataFrame) -> bool:
    """Whether no text stands twice under one id."""
    return slim.groupBy("_d", *KEY).count().where("count > 1").isEmpty()
