"""Token counts of a unigram tokenizer without its pieces: count-only Viterbi.

An Aho-Corasick automaton over the vocabulary enumerates the pieces that end at each character, longest
first; the best score so far and the number of pieces of that best path are all that dynamic programming
carries. Ties go to the piece that starts earliest, as in the tokenizer, which only replaces a path by a
strictly better one. A character without a piece of its own may be unknown, ten below the worst score, and
counts as its UTF-8 bytes where the vocabulary has byte pieces (else a run of unknowns is one token).

Spaces become the word mark, one is put in front, and no piece crosses a mark, so counts add up over words and
each worker keeps the counts of words it has seen, within a bounded table.

Edge cases: null and empty texts have no tokens. Words of any length take time in proportion. Repeated rows
each get a row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
KNOWN_WORDS = 400_000
UNKNOWN_PENALTY = 10.0


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        self.pieces = pieces
        self.known: dict[str, int] = {}
        self.automaton = None

    def __getstate__(self) -> dict:
        return {"pieces": self.pieces, "known": {}, "automaton": None}

    def build(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        names = {p for p, _ in self.pieces}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.unknown = min(s for _, s in self.pieces) - UNKNOWN_PENALTY

    def word(self, word: str) -> int:
        """Pieces of one word with its mark."""
        n = len(word)
        score, count, ends_unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(word):
            ending[end].append(match)
        for end in range(1, n + 1):
            best = None
            single = False
            for length, s in ending[end - 1]:
                single |= length == 1
                s += score[end - length]
                if best is None or s > best:
                    best, pieces = s, count[end - length] + 1
            unknown = False
            if not single:
                s = score[end - 1] + self.unknown
                if best is None or s > best:
                    unknown, best = True, s
                    fused = not self.bytes and ends_unknown[end - 1]
                    size = len(word[end - 1].encode()) if self.bytes else 1
                    pieces = count[end - 1] + (0 if fused else size)
            score[end], count[end], ends_unknown[end] = best, pieces, unknown
        return count[n]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        if self.automaton is None:
            self.build()
        words = text.replace(MARK, " ").split(" ")
        if words[0] == "":
            del words[0]  # the text's own space takes the place of the one in front
        known, total = self.known, 0
        for w in words:
            c = known.get(w)
            if c is None:
                c = self.word(MARK + w)
                if len(w) <= 64:
                    if len(known) >= KNOWN_WORDS:
                        known.clear()
                    known[w] = c
            total += c
        return total


def vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """Pieces and scores of a tokenizer file, read once by the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


def counted(docs: DataFrame, pieces: list[tuple[str, float]]) -> DataFrame:
    """doc_id, characters and tokens of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(Counter(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [shared.value.text(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_chars"), pa.array(tokens, pa.int64())],
                names=["doc_id", "n_chars", "n_tokens"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    slim = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "text")
    return slim.mapInArrow(run, f"doc_id {kind}, n_chars bigint, n_tokens bigint")
