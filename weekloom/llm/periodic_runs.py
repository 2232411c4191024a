"""Periodic runs: stretches of words that repeat with a period at least four times, and texts without the repeats.

A run is a stretch whose smallest period is q, whose length is at least max(6, 4 q), and which no neighbouring word
extends. Periods are searched by octaves, q in [2**j, 2**(j+1)). A text is cut into overlapping tiles per octave, of
sixteen times the octave's shortest period; the octaves up to 256 words share tiles, and a text within one tile
needs no cutting. Tiles are solved independently. Every 2**j words stands a boundary, and a run of the octave holds
two of them at least with the 2**j words after them and those words' repeats. At a boundary m the Z-value of
(m, q), how far the words from m on equal those from m + q on, and the same to the left, give the run's fragment.

Z-values of all boundaries and periods of an octave are found at once, in numpy: blocks of 2**k words get numbers that
are equal exactly where the blocks are (each level numbers pairs of the level below), and a Z-value is the sum of
the powers of two by which equal blocks continue. As soon as no block of a level stands twice, all longer periods
are done. Nothing is hashed, so nothing is wrong by chance.

Fragments of a period that touch are joined; those that leave their tile's core go on in the next. They are shuffled
by document and period and stitched; a stretch found with several periods counts with the smallest. A fragment inside a stretch
of a period that divides its own is dropped at once, or a text of one word would have fragments of all periods.

Tiles of texts beyond one tile are dealt out to all tasks, so that one huge text is solved by many. Texts travel only if
they hold a fragment or were dealt out; all others are finished where they are read.

Edge cases: null and empty texts have no words, no runs and an empty collapsed text. Repeated rows each have a row.
Rows without an id are rows of their own. Ties of the strongest run go to the smaller start, then period.
An empty table gives none. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.llm.words import as_bytes
from weekloom.session import stage

TILE = 4096
TIMES = 4  # a run holds its period so many times, and
LEAST = 6  # so many words
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
FRAGMENT = "array<struct<q:bigint,s:bigint,e:bigint>>"


def numbers(words: list[bytes]) -> np.ndarray:
    """Equal words, equal numbers."""
    distinct = dict.fromkeys(words)
    known = dict(zip(distinct, range(len(distinct))))
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def tiles(n: int, size: int = TILE) -> Iterator[tuple[int, int, int, int]]:
    """(first octave, last octave, core start, core end) of a text of ``n`` words.

    The first tiles serve all octaves up to 1/16 of their size; beyond, an octave has tiles of 16 times its period.
    Octaves whose tile holds the whole text share one.
    """
    top = max(n // TIMES, 1).bit_length() - 1
    shared = max(size // 16, 1).bit_length() - 1
    low, high = 0, shared
    while low <= top:
        core = max(size, 16 << high)
        if core >= n:
            yield low, top, 0, n
            return
        yield from ((low, high, at, min(at + core, n)) for at in range(0, n, core))
        low = high = high + 1


def reach(octave: int) -> tuple[int, int]:
    """Words that a tile needs in front of its core and after it."""
    return 2 << octave, 4 << octave


def merged(q: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fragments of a period that touch become one."""
    order = np.lexsort((e, s, q))
    q, s, e = q[order], s[order], e[order]
    new = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (s[1:] > e[:-1])]))
    return q[new], s[new], e[np.append(new[1:], len(q)) - 1]


def solve(x: np.ndarray, low: int, high: int, start: int, end: int, n: int) -> list[tuple[int, int, int]]:
    """Fragments (q, s, e) of a tile: the words s..e equal those q further on.

    ``x`` are the tile's words, of which ``start``..``end`` are its core; ``n`` is the length of the whole text.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size, names = len(x), []
    for j in range(high + 1):
        step = 1 << j
        if j == 0:
            name = x
        elif size < step:
            break
        else:
            below = names[-1]
            _, name = np.unique(below[: size - step + 1] * size + below[step // 2 :][: size - step + 1], return_inverse=True)
        if len(name) and name.max() == len(name) - 1:
            break  # every block is unique, and so are all longer ones
        names.append(name)
        if j < low:
            continue
        at = np.arange(start, end, step)
        period = np.arange(step, min(2 * step, n // TIMES + 1))
        if not len(period):
            break
        # Blocks that no tile holds whole equal none.
        closed = np.concatenate([name, -1 - np.arange(size + 2 * step - len(name))])
        m, k = np.nonzero(closed[at[:, None] + period] == closed[at][:, None])
        if not len(m):
            continue
        m, q = at[m], period[k]
        s, e = m.copy(), m.copy()
        for level in range(j, -1, -1):
            name, block = names[level], 1 << level
            last = len(name) - 1
            ok = e + q <= last
            ok[ok] = name[e[ok]] == name[e[ok] + q[ok]]
            e += block * ok
            ok = s >= block
            ok[ok] = name[s[ok] - block] == name[s[ok] - block + q[ok]]
            s -= block * ok
        q, s, e = merged(q, s, e)
        # Within the core a fragment is whole; one that leaves it may go on in the next tile.
        keep = (s < start) | (e >= end) | (e - s + q >= np.maximum(LEAST, TIMES * q))
        if keep.any():
            part = without_multiples((q[keep], s[keep], e[keep]), found)
            if len(part[0]):
                found.append(part)
    return [(int(q), int(s), int(e)) for part in found for q, s, e in zip(*part)]


def without_multiples(part: tuple, found: list[tuple]) -> tuple:
    """Fragments but for those inside a stretch whose period divides theirs."""
    q, s, e = part
    for own, first, last in found:
        order = np.argsort(first, kind="stable")
        own, first, last = own[order], first[order], (last + own)[order]
        furthest = np.maximum.accumulate(np.where(last == np.maximum.accumulate(last), np.arange(len(last)), 0))
        at = np.searchsorted(first, s, "right") - 1
        over = furthest[np.maximum(at, 0)]
        gone = (at >= 0) & (last[over] >= e + q) & (q % own[over] == 0)
        q, s, e = q[~gone], s[~gone], e[~gone]
    return q, s, e


def rendered(words: list[bytes], texts: bool) -> str:
    text = b" ".join(words)
    return text.decode() if texts else hashlib.sha256(text).hexdigest()


KINDS = {
    "_n": pa.int64(),
    "_fragments": pa.list_(pa.struct([(k, pa.int64()) for k in ("q", "s", "e")])),
    "_text": pa.binary(),
    "_plain": pa.string(),
    "_low": pa.int32(),
    "_high": pa.int32(),
    "_at": pa.int64(),
    "_start": pa.int64(),
    "_end": pa.int64(),
    "_ids": pa.binary(),
}
CUT = (
    f"_n bigint, _fragments {FRAGMENT}, _text binary, _plain string, "
    "_low int, _high int, _at bigint, _start bigint, _end bigint, _ids binary"
)
OF_TEXT, OF_TILE = ["_n", "_fragments", "_text", "_plain"], ["_n", "_low", "_high", "_at", "_start", "_end", "_ids"]


def batch_of(part: pa.RecordBatch, rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Rows (index in ``part``, then ``names``); columns that they lack are null."""
    index, *values = zip(*rows)
    made = {n: pa.array(list(v), KINDS[n]) for n, v in zip(names, values)}
    index = pa.array(index, pa.int64())
    keys = [part.column("_row").take(index), part.column("doc_id").take(index)]
    return pa.RecordBatch.from_arrays(
        [*keys, *(made.get(n, pa.nulls(len(rows), k)) for n, k in KINDS.items())], names=["_row", "doc_id", *KINDS]
    )


def cut(batches: Iterator[pa.RecordBatch], texts: bool, size: int) -> Iterator[pa.RecordBatch]:
    """A row for each text, with its fragments if one tile holds it, and rows with the tiles of the others."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            rows, more, held = [], [], 0
            for i, text in enumerate(as_bytes(part.column("text"))):
                words = (text or b"").split()
                n, x, pieces = len(words), numbers(words), list(tiles(len(words), size))
                one = len(pieces) == 1
                fragments = [dict(zip("qse", f)) for f in solve(x, *pieces[0], n)] if one else []
                open_ = bool(fragments) or not one
                rows.append((i, n, fragments, text if open_ else None, None if open_ else rendered(words, texts)))
                for low, high, start, end in () if one else pieces:
                    left, right = reach(high)
                    first = max(0, start - left)
                    ids = x[first : end + right].astype("<i4").tobytes()
                    more.append((i, n, low, high, first, start - first, end - first, ids))
                    held += len(ids)
                    if held > 8_000_000:
                        yield batch_of(part, more, OF_TILE)
                        more, held = [], 0
            yield batch_of(part, rows, OF_TEXT)
            if more:
                yield batch_of(part, more, OF_TILE)


def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments of tiles, placed in their texts."""
    for batch in batches:
        for r in batch.to_pylist():
            x = np.frombuffer(r["_ids"], "<i4").astype(np.int64)
            _, x = np.unique(x, return_inverse=True)
            out = solve(x, r["_low"], r["_high"], r["_start"], r["_end"], r["_n"])
            q, s, e = np.array(out, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(q), r["_row"])), pa.array(q), pa.array(s + r["_at"]), pa.array(e + r["_at"])],
                names=["_row", "q", "s", "e"],
            )


def stitched(fragments: DataFrame) -> DataFrame:
    """(``_row``, ``runs``): fragments of a document and period joined where they touch, short ones left out."""
    own = Window.partitionBy("_row", "q")
    upto = own.orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    inside = own.orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)
    new = F.coalesce(F.col("s") > F.max("e").over(upto), F.lit(True)).cast("int")
    length = F.col("e") - F.col("s") + F.col("q")
    return (
        fragments.withColumn("_new", new)
        .withColumn("_island", F.sum("_new").over(inside))
        .groupBy("_row", "q", "_island")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
        .where(length >= F.greatest(F.lit(LEAST), TIMES * F.col("q")))
        .groupBy("_row", F.col("s").alias("start"), length.alias("length"))
        .agg(F.min("q").alias("period"))
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    )


def finished(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    """Strongest run and collapsed text of texts with their runs."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            best, text = [], []
            for runs, raw in zip(part.column("runs").to_pylist(), as_bytes(part.column("_text"))):
                words = (raw or b"").split()
                edge = np.zeros(len(words) + 1, np.int64)
                for r in runs or []:
                    edge[r["start"] + r["period"]] += 1
                    edge[r["start"] + r["length"]] -= 1
                gone = np.cumsum(edge)
                text.append(rendered([w for w, g in zip(words, gone) if not g], texts))
                strength = lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"])
                best.append(max(runs, key=strength) if runs else None)
            kind = pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("_n"), part.column("runs"), pa.array(best, kind), pa.array(text, pa.string())],
                names=["doc_id", "n_words", "runs", "strongest", "collapsed"],
            )


def find(docs: DataFrame, texts: bool = True, size: int = TILE) -> DataFrame:
    """doc_id, words, runs in order, strongest run, and the text without repeats (or its SHA-256) of every text."""
    read = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    kind = read.schema["doc_id"].dataType.simpleString()
    rows = stage(
        read.mapInArrow(lambda b: cut(b, texts, size), f"_row bigint, doc_id {kind}, {CUT}"), "runs-tiles"
    )
    of_texts = rows.where("_fragments IS NOT NULL")
    here = of_texts.select("_row", F.explode("_fragments").alias("f")).select("_row", "f.q", "f.s", "f.e")
    dealt = rows.where("_ids IS NOT NULL").select("_row", *OF_TILE).repartition("_row", "_low", "_at")
    elsewhere = dealt.mapInArrow(solved, "_row bigint, q bigint, s bigint, e bigint")
    runs = stage(stitched(here.union(elsewhere)), "runs")
    none = F.array().cast(RUN)
    # Always by a shuffle: texts of documents with runs grow with the input, and so do the runs.
    held = of_texts.where("_plain IS NULL").join(runs.hint("merge"), "_row", "left")
    done = held.select("doc_id", "_n", "_text", F.coalesce("runs", none).alias("runs")).mapInArrow(
        lambda b: finished(b, texts), f"doc_id {kind}, n_words bigint, runs {RUN}, strongest {RUN[6:-1]}, collapsed string"
    )
    plain = of_texts.where("_plain IS NOT NULL").select(
        "doc_id", "_n", none.alias("runs"), F.lit(None).cast(RUN[6:-1]).alias("strongest"), "_plain"
    )
    return done.union(plain)


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` as the query reads them: every tenth text, by checksum of its id, ends in a repetition.

    From word a on, its words repeat with period p; both follow from the checksum. A null id has none.
    """

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = as_bytes(part.column("text"))
                for i, h in enumerate(part.column("_h").to_pylist()):
                    if h is None or h % 10 or not (words := (texts[i] or b"").split()):
                        continue
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    texts[i] = b" ".join(words[:a] + [words[a + k % p] for k in range(n - a)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("_h"))
    return read.mapInArrow(plant, f"doc_id {kind}, text binary")


def digest(found: DataFrame) -> DataFrame:
    """Numbers and digests of what ``find(texts=False)`` returns."""
    best = F.col("strongest")
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.col("collapsed").alias("collapsed_sha256"),
    )
