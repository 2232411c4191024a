"""Packing of tokenised texts into windows by Karmarkar-Karp differencing.

A task reads its texts in order. Full windows of a long text leave at once; what remains of each text, whole as a
rule, is collected until it fills ``group`` windows to the token. Multiway differencing then deals these pieces
out: every piece is a partition of the windows with one of them filled; the two partitions of the largest imbalance
are merged again and again, the fullest window of one onto the emptiest of the other, until one partition is left,
whose windows are near-equal (for common text lengths within some 5 % of a window).

Capacity is met in three ways. A window that stands above it by ``shift`` tokens at most is cut at its end and fills
windows that stand below: as the pieces fill the windows to the token, nothing is padded. Beyond that, pieces are cut in
halves, down to an eighth of a window, and dealt out anew. If even that does not do, the window count rises by one. Of the last pieces of a task, the
tokens beyond whole windows become sequences of powers of two, which are not padded either.

No text leaves its task, and a task holds the tokens of one group and one slice of texts, so the cost is in proportion
and the result depends on nothing but how the input is split.

Tokens come from a tokenizer whose words never cross white space. Each worker keeps the tokens of words it has seen, in a bounded
table; new words are encoded many at a time.

Edge cases: null and empty texts are the end token alone. Rows without an id and repeated rows are packed like all
others. Texts of any length are cut as they need. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from weekloom.llm.words import as_bytes

KNOWN_WORDS = 1_000_000
#: Texts that are tokenised together.
SLICE = 256
#: A word and marks behind it, which are tokens of their own.
MARKED = re.compile(rb"([a-z\x80-\xff]+)([!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]+)")


@dataclass(frozen=True)
class Packing:
    window: int = 2048
    group: int = 128  # windows that are filled together
    shift: int = 256  # tokens that may move from one window to others


class Encoder:
    """Packed 32-bit ids of texts, through the words between white space."""

    def __init__(self, tokenizer: str) -> None:
        self.tokenizer, self.known, self.exact, self.light = tokenizer, {}, None, None

    def __getstate__(self) -> dict:
        return {"tokenizer": self.tokenizer, "known": {}, "exact": None, "light": None}

    def build(self) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.exact = Tokenizer.from_str(self.tokenizer)
        self.exact.encode_special_tokens = True
        # Small letters of ASCII are what normalising and splitting leave as they are.
        self.light = Tokenizer.from_str(self.tokenizer)
        self.light.encode_special_tokens = True
        self.light.normalizer, self.light.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        names = self.exact.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True

    def encode(self, words: set[bytes]) -> None:
        """Learn new words. Words of letters are encoded in one text, and told apart by the ends in their tokens."""
        ascii, plain, other = [], [], []
        for w in words:
            (ascii if w.isalpha() else plain if letters(w) else other).append(w)
        for tokenizer, many in ((self.light, ascii), (self.exact, plain)):
            # Without offsets, which nobody reads.
            whole = tokenizer.encode_batch_fast([b" ".join(many).decode()], add_special_tokens=False)[0]
            ids = np.array(whole.ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(many):
                raw, cuts = ids.tobytes(), (4 * ends).tolist()
                self.known.update((w, raw[at:end]) for w, at, end in zip(many, [0, *cuts], cuts))
            else:
                other += many
        for w, e in zip(other, self.exact.encode_batch_fast([w.decode() for w in other], add_special_tokens=False)):
            self.known[w] = np.array(e.ids, "<u4").tobytes()

    def texts(self, texts: list[bytes | None]) -> list[bytes]:
        if self.exact is None:
            self.build()
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        known = self.known
        # One look-up per word; only those without a result are looked up again.
        words = [(t or b"").lower().split() for t in texts]
        found = [list(map(known.get, text)) for text in words]
        gaps = [[i for i, ids in enumerate(row) if ids is None] for row in found]
        new = {text[i] for text, at in zip(words, gaps) for i in at}
        parts = {w: m.groups() for w in new if not w.isalpha() and (m := MARKED.fullmatch(w)) and letters(m[1])}
        self.encode({w for w in (new - parts.keys()).union(*parts.values()) if w not in known})
        for w, (a, b) in parts.items():
            known[w] = known[a] + known[b]
        for text, row, at in zip(words, found, gaps):
            for i in at:
                row[i] = known[text[i]]
        return [b"".join(row) for row in found]


def letters(word: bytes) -> bool:
    """Whether the tokenizer sees letters alone; the bytes' own ``isalpha`` knows those of ASCII."""
    return word.isalpha() or unicodedata.normalize("NFC", word.decode()).lower().isalpha()


#: A piece of a text: (text, start, length).
Piece = tuple[int, int, int]


def differenced(pieces: list[Piece], k: int) -> list[list[Piece]]:
    """``k`` windows of near-equal length by Karmarkar-Karp multiway differencing."""
    heap = []
    for i, p in enumerate(pieces):
        sums = np.zeros(k, np.int64)
        sums[-1] = p[2]
        heap.append((-p[2], i, sums, [None] * (k - 1) + [(None, p)]))
    heapq.heapify(heap)
    for i in range(len(pieces), 2 * len(pieces) - 1):
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(sums, kind="stable")
        joined = [(x, y) if x and y else x or y for x, y in zip(in_a, reversed(in_b))]
        sums = sums[order] - sums[order[0]]
        heapq.heappush(heap, (-int(sums[-1]), i, sums, [joined[j] for j in order.tolist()]))
    return [unfolded(node) for node in heap[0][3]] if heap else []


def unfolded(node: tuple | None) -> list[Piece]:
    """The pieces of a tree of merges, whose leaves are (None, piece)."""
    out, todo = [], [node] if node else []
    while todo:
        left, right = todo.pop()
        if left is None:
            out.append(right)
        else:
            todo += [right, left]
    return out


def halved(pieces: list[Piece], most: int) -> list[Piece]:
    return [(d, s + at, min(most, n - at)) for d, s, n in pieces for at in range(0, n, most)]


def take(window: list[Piece], size: int) -> list[Piece]:
    """Take ``size`` tokens off the end of a window."""
    out = []
    while size:
        d, s, n = window.pop()
        part = min(n, size)
        if part < n:
            window.append((d, s, n - part))
        out.append((d, s + n - part, part))
        size -= part
    return out


def filled(pieces: list[Piece], cfg: Packing) -> list[list[Piece]]:
    """Windows within capacity."""
    total = sum(p[2] for p in pieces)
    if not total:
        return []
    count, most = -(-total // cfg.window), cfg.window
    while True:
        windows = differenced(pieces, count)
        sums = [sum(p[2] for p in w) for w in windows]
        if max(sums) <= cfg.window + cfg.shift:
            break
        if most > cfg.window // 8:
            most //= 2
            pieces = halved(pieces, most)
        else:
            count += 1
    low = [i for i, s in enumerate(sums) if s < cfg.window]
    for i, s in enumerate(sums):
        while s > cfg.window:
            to = low[-1]
            part = min(s - cfg.window, cfg.window - sums[to])
            windows[to] += take(windows[i], part)
            s, sums[to] = s - part, sums[to] + part
            if sums[to] == cfg.window:
                low.pop()
    return windows


def rest(pieces: list[Piece], cfg: Packing) -> list[list[Piece]]:
    """Full windows, and sequences of powers of two for what is beyond them."""
    pieces = list(pieces)
    beyond = sum(p[2] for p in pieces) % cfg.window
    short = [take(pieces, 1 << b) for b in range(beyond.bit_length()) if beyond >> b & 1]
    return filled(pieces, cfg) + short


class Packer:
    """Texts of one task on their way into windows."""

    def __init__(self, cfg: Packing, first: int) -> None:
        self.cfg, self.next = cfg, first
        self.kept: dict[int, tuple] = {}
        self.pieces: list[Piece] = []
        self.size = self.texts = 0

    def add(self, doc: object, ids: bytes) -> Iterator[tuple]:
        """Take in a text; yield finished pieces."""
        cfg, n = self.cfg, len(ids) // 4
        self.texts += 1
        own = self.texts
        self.kept[own] = (doc, ids)
        full = n - n % cfg.window
        for start in range(0, full, cfg.window):
            yield from self.put([[(own, start, cfg.window)]])
        at = full
        while at < n:
            part = min(n - at, cfg.group * cfg.window - self.size)
            self.pieces.append((own, at, part))
            self.size += part
            at += part
            if self.size == cfg.group * cfg.window:
                yield from self.put(filled(self.pieces, cfg))
                last = self.kept[own]
                self.kept.clear()
                self.kept[own] = last
                self.pieces, self.size = [], 0
        if full == n:
            del self.kept[own]

    def end(self) -> Iterator[tuple]:
        yield from self.put(rest(self.pieces, self.cfg))

    def put(self, windows: list[list[Piece]]) -> Iterator[tuple]:
        for window in windows:
            offset = 0
            for own, start, length in window:
                doc, ids = self.kept[own]
                yield doc, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, self.next, offset
                offset += length
            self.next += offset > 0


def tokenizer_file(path: str | None = None) -> str:
    """The tokenizer's description, read once by the driver."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()


NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, cfg: Packing = Packing()) -> DataFrame:
    """A row per piece: its text's id, place and ids (packed, little-endian, 32 bits), sequence and offset in it."""
    shared = docs.sparkSession.sparkContext.broadcast(Encoder(tokenizer))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(cfg, TaskContext.get().partitionId() << 33)
        kind = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows), kinds)], names=NAMES)

        rows: list[tuple] = []
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = shared.value.texts(as_bytes(part.column("text")))
                for doc, ids in zip(part.column("doc_id").to_pylist(), texts):
                    rows += packer.add(doc, ids + end)
                if rows:
                    yield out(rows)
                    rows = []
        rows += packer.end()
        if rows:
            yield out(rows)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
