"""Benchmark decontamination by a generalised suffix automaton of the test items.

Words are lower-cased letters and digits. The automaton is built over the words of all items; the words of a
text are streamed through it, which gives the longest match that ends at each word. A match of ``window``
words or more hits all its words; an item of fewer words is hit as a whole. Runs of words that all occur in
some item are found with numpy first, so the automaton sees only text that can match.

The automaton is broadcast only within ``max_bytes`` of item text; more items are split into groups of that
size, each with an automaton and a pass of its own, so the result stays whole.

Edge cases: null and empty texts have no words and no hits. Items without words have no window. Repeated items
count with each distinct id; null ids are left out of the list of items. Texts of any length are streamed.
An empty table of items hits nothing. Extra columns travel in a struct and cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import with_text
from weekloom.llm.words import LETTERS, Words, as_bytes, passes

WINDOW = 10
MAX_BYTES = 32_000_000
HITS = "array<struct<first:int,last:int>>"


@dataclass(frozen=True)
class Limits:
    """Spans of ``span_words`` hit words go; beyond ``coverage`` of all words the whole document goes."""

    span_words: int = 1
    coverage: float = 0.5


class Automaton:
    """Generalised suffix automaton over word numbers."""

    def __init__(self, items: list[tuple[object, bytes]], window: int) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.number: dict[bytes, int] = {}
        parsed = []
        for k, part in passes([t for _, t in items]):
            w = Words(part, LETTERS)
            raw = w.data.tobytes()
            for j in range(len(part)):
                span = range(w.cut[j], w.cut[j + 1])
                ids = [self.number.setdefault(raw[w.start[x] : w.end[x]], len(self.number)) for x in span]
                parsed.append((items[k + j][0], ids))
        self.known = np.unique(Words([b" ".join(self.number)], LETTERS).hash)
        for _, ids in parsed:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.items: dict[int, set] = {}
        self.short: dict[int, list[tuple[object, int]]] = {}
        for item, ids in parsed:
            self._mark(item, ids)
        self.shortest = min((min(len(ids), window) for _, ids in parsed if ids), default=window)

    def _state(self, link: int, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of the shorter strings of q that end by c from p."""
        new = self._state(self.link[q], self.length[p] + 1, dict(self.next[q]))
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(0, self.length[last] + 1, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _of_length(self, v: int, n: int) -> int:
        """The state of the last n words of a match in state v."""
        while self.length[self.link[v]] >= n if self.link[v] >= 0 else False:
            v = self.link[v]
        return v

    def _mark(self, item: object, ids: list[int]) -> None:
        n, v = min(len(ids), self.window), 0
        for at, c in enumerate(ids, 1):
            v = self.next[v][c]
            if at >= n:
                u = self._of_length(v, n)
                if n == self.window:
                    self.items.setdefault(u, set()).add(item)
                else:
                    self.short.setdefault(u, []).append((item, n))

    def stream(self, ids: list[int]) -> tuple[list[tuple[int, int]], set]:
        """Hit ranges (first, last word) and the items whose windows occur."""
        v = matched = 0
        hits, found = [], set()
        for at, c in enumerate(ids):
            while v and c not in self.next[v]:
                v = self.link[v]
                matched = self.length[v]
            if c in self.next[v]:
                v, matched = self.next[v][c], matched + 1
            longest = 0
            if matched >= self.window:
                longest = matched
                found |= self.items.get(self._of_length(v, self.window), set())
            if self.short:
                u = v
                while u > 0:
                    for item, n in self.short.get(u, ()):
                        if n <= matched:
                            longest = max(longest, n)
                            found.add(item)
                    u = self.link[u]
            if longest:
                hits.append((at - longest + 1, at))
        return hits, found

    def match(self, w: Words, first: int, last: int) -> tuple[list[tuple[int, int]], set]:
        """Merged hit ranges and items of words first..last-1."""
        known = self.is_known[first:last]
        edge = np.diff(known.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        merged, found = [], set()
        for a, b in zip(starts, ends):
            if b - a < self.shortest:
                continue
            text = w.data
            ids = [self.number.get(text[w.start[x] : w.end[x]].tobytes(), -1) for x in range(first + a, first + b)]
            hits, items = self.stream(ids)
            found |= items
            for x, y in hits:
                x, y = int(a + x), int(a + y)
                if merged and x <= merged[-1][1] + 1:
                    # A later range may reach back over several earlier ones.
                    while merged and x <= merged[-1][1] + 1:
                        x = min(x, merged.pop()[0])
                merged.append((x, y))
        return merged, found

    def prepare(self, w: Words) -> None:
        at = np.searchsorted(self.known, w.hash)
        at[at == len(self.known)] = 0
        self.is_known = self.known[at] == w.hash if len(self.known) else np.zeros(len(w.hash), bool)


def item_groups(benchmark: DataFrame, max_bytes: int) -> list[list[tuple[object, bytes]]]:
    """The items in groups of bounded size; their total is counted before any is fetched."""
    items = benchmark.select("item_id", "text").where("text IS NOT NULL AND text != ''")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // max_bytes)
    key = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(parts, 1)))
    groups = []
    for k in range(parts):
        rows = items.where(key == k).collect() if parts > 1 else items.collect()
        groups.append([(r[0], r[1].encode()) for r in rows])
    return groups


def matched(docs: DataFrame, benchmark: DataFrame, window: int, max_bytes: int) -> DataFrame:
    """``docs`` with ``_n_words``, ``_hits`` (disjoint ranges, in order), ``_items`` (ids as sorted strings), and
    ``_clean``, the text without its hit words; ``docs`` has ``_text``."""
    spark = docs.sparkSession
    groups = item_groups(benchmark, max_bytes)
    df = docs.withColumns({"_n_words": F.lit(0), "_hits": F.array().cast(HITS), "_items": F.array().cast("array<string>")})
    for items in groups or [[]]:
        shared = spark.sparkContext.broadcast(Automaton(items, window))
        df = df.mapInArrow(lambda batches, b=shared: _annotate(batches, b.value), df.schema)
    return df


def _annotate(batches: Iterator[pa.RecordBatch], automaton: Automaton) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        before, known_items = batch.column("_hits").to_pylist(), batch.column("_items").to_pylist()
        counts, hits, items = [], [], []
        for at, part in passes(batch.column("_text")):
            w = Words(part, LETTERS)
            automaton.prepare(w)
            for k in range(len(part)):
                ranges, found = automaton.match(w, w.cut[k], w.cut[k + 1])
                counts.append(int(w.cut[k + 1] - w.cut[k]))
                old = [(h["first"], h["last"]) for h in before[at + k]]
                hits.append([{"first": a, "last": b} for a, b in (union(old + ranges) if old else ranges)])
                items.append(sorted({*known_items[at + k], *(str(x) for x in found if x is not None)}))
        new = {"_n_words": counts, "_hits": hits, "_items": items}
        yield pa.RecordBatch.from_arrays(
            [pa.array(new[f.name], f.type) if f.name in new else batch.column(f.name) for f in batch.schema],
            schema=batch.schema,
        )


def union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(batches: Iterator[pa.RecordBatch], span_words: int) -> Iterator[pa.RecordBatch]:
    """``_clean``: the text without its long hit spans, each with the gap behind it."""
    for batch in batches:
        column = batch.column("_text")
        texts, hits = as_bytes(column), batch.column("_hits").to_pylist()
        clean = list(texts)
        for k, ranges in enumerate(hits):
            spans = [(h["first"], h["last"]) for h in ranges if h["last"] - h["first"] + 1 >= span_words]
            if spans:
                w = Words([texts[k]], LETTERS)
                starts = np.append(w.start, len(texts[k]))
                kept, at = [], 0
                for a, b in spans:
                    kept.append(texts[k][at : w.start[a]])
                    at = int(starts[b + 1])
                clean[k] = b"".join([*kept, texts[k][at:]])
        clean = pa.array([None if t is None else t.decode() for t in clean], column.type)
        yield pa.RecordBatch.from_arrays([*batch.columns, clean], names=[*batch.schema.names, "_clean"])


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Per document: words, hit words, spans and items found."""
    df = matched(docs.select("doc_id", F.col("text").alias("_text")), benchmark, window, max_bytes)
    n_hit = F.aggregate("_hits", F.lit(0).cast("long"), lambda a, h: a + h["last"] - h["first"] + 1)
    return df.select(
        "doc_id",
        F.col("_n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("_hits") > 0).alias("contaminated"),
    )


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    limits: Limits = Limits(),
    window: int = WINDOW,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """``docs`` without leaked spans and without documents that are mostly leaked."""
    df = matched(
        docs.select(F.struct("*").alias("_doc"), F.col("text").alias("_text")), benchmark, window, max_bytes
    )
    n_hit = F.aggregate("_hits", F.lit(0).cast("long"), lambda a, h: a + h["last"] - h["first"] + 1)
    kept = df.where(n_hit <= limits.coverage * F.col("_n_words"))
    schema = f"{kept.select('_doc', '_text', '_hits').schema.simpleString()[7:-1]},_clean:string"
    cut = kept.select("_doc", "_text", "_hits").mapInArrow(lambda b: _cut(b, limits.span_words), schema)
    return with_text(cut, "_clean")


SQL = r"""
WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS MATERIALIZED (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM i WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
one AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS k FROM w),
dw AS (
  SELECT r, k - n + 1 AS k, n, string_agg(x, ' ') OVER (PARTITION BY r, n ORDER BY k ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS g
  FROM one, ns WHERE n = 10
  UNION ALL
  SELECT r, k, n, array_to_string(w[k + 1:k + n], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS k FROM w, ns WHERE n < 10 AND len(w) >= n)),
m AS (SELECT DISTINCT r, k, n, g FROM dw WHERE k >= 0 AND g IN (SELECT g FROM iw)),
hit AS (SELECT r, count(DISTINCT k + o) AS n_hit FROM (SELECT r, k, unnest(range(n)) AS o FROM m) GROUP BY r),
its AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT m.r, iw.item_id::VARCHAR AS item FROM m JOIN iw USING (n, g)) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
