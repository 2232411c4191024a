"""Merkle manifest, packing and periodic runs against brute force and on edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weekloom.llm import merkle_manifest, midstate, packing, periodic_runs
from weekloom.llm.registry import op11_merkle_manifest, op12_packing, op13_periodic_runs

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row int, _pos long, start string, leaf int"
QUERIES = {
    "manifest": merkle_manifest.verified,
    "packing": lambda d: packing.packed(d, packing.tokenizer_file()),
    "runs": lambda d: periodic_runs.digest(periodic_runs.find(periodic_runs.planted(d), texts=False)),
}


def prose(seed, n, letters="abcdefghij"):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_rows():
    long = prose(1, 30_000)
    texts = [None, "", " \n ", "one", long, long, "a " * 9000, "ä ö\n" * 40, prose(2, 80)]
    rows = [(i, t, None, "s" if i % 3 else None, 1, 5, 7, "x", 1) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, "null id " * 30, None, None, None, None, None, None, None), (None,) * 9]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.mark.parametrize("name", QUERIES)
def test_empty_table(spark, name):
    assert QUERIES[name](spark.createDataFrame([], SCHEMA)).count() == 0


# Manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_climb(levels, place, now):
    proof = []
    for nodes in levels[:-1]:
        first = place - place % 3
        run = nodes[first : first + 3]
        proof += [x for k, x in enumerate(run) if first + k != place]
        run[place - first] = now
        now, place = h(*run), place // 3
    return proof, now


def plain_manifest(rows):
    """Expected results of rows (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = plain_levels([trees[s][-1][0] for s in names])
    root, out = top[-1][0], []
    for g, s in enumerate(names):
        for place, (_, _, leaf, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            new = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                new = plain_leaf((*r[:4], r[4].replace("\n", "")))
            low, sub = plain_climb(trees[s], place, new)
            high, now = plain_climb(top, g, sub)
            out.append((r[0], leaf, trees[s][-1][0], root, h(*low, *high), now, now == root))
    return sorted(out, key=repr)


def test_manifest_equals_brute_force_on_odd_rows(spark, odd):
    want = plain_manifest([(r[0], r[3], r[2], r[4], r[1]) for r in odd_rows()])
    assert sorted(map(tuple, merkle_manifest.verified(odd).collect()), key=repr) == want


@pytest.mark.parametrize("n", [1, 3, 4, 729, 730, 2200])
def test_manifest_of_chunks_and_rounds(spark, n):
    """A group beyond one chunk, one of a single leaf, and many small groups, up to two rounds of each tree."""
    rows = [(i, "big", "en", i % 7, f"text\n{i}") for i in range(n)]
    rows += [(i, f"s{i % (n // 2 + 1)}", None, 1, "x") for i in range(n)] + [(5, None, "de", 2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted(map(tuple, merkle_manifest.verified(docs).collect()), key=repr) == plain_manifest(rows)


def test_manifest_folds_any_change(spark):
    """Roots after a change equal the roots of a manifest built anew."""
    rows = [(i, f"s{i % 2}", f"t{i}") for i in range(40)]
    build = lambda rows: merkle_manifest.manifest(
        spark.createDataFrame(rows, "id long, g string, t string"),
        F.col("g"),
        F.col("id"),
        merkle_manifest.leaf(F.col("t")),
        {"id": F.col("id"), "new": F.when(F.col("id") == 17, merkle_manifest.leaf(F.lit("other")))},
    )
    got = {r["id"]: r for r in build(rows).fold("new").collect()}
    changed = build([(i, g, "other" if i == 17 else t) for i, g, t in rows])
    assert got[17]["folded_root"] == changed.roots().first()["_root"] != got[17]["root"]
    assert all(r["folded_root"] == r["root"] for i, r in got.items() if i != 17)


def test_midstates_resume():
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(9000)]
    state = midstate.compress(midstate.fresh(9000), midstate.hex_block(midstate.from_bytes(leaves)))
    both = midstate.compress(state.copy(), midstate.hex_block(midstate.from_bytes(leaves[::-1])))
    want = [hashlib.sha256((a.hex() + b.hex()).encode()).digest() for a, b in zip(leaves, leaves[::-1])]
    assert midstate.to_bytes(midstate.finish(both, np.full(9000, 2))) == want


# Packing


def check_packing(got, texts, window=2048):
    """Every token of every text in exactly one piece, sequences without gaps; returns the padding."""
    exact = Tokenizer.from_str(packing.tokenizer_file())
    exact.encode_special_tokens = True
    whole = {k: exact.encode(t or "", add_special_tokens=False).ids + [1] for k, t in texts.items()}
    by_text, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_text[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        ids = whole[r["doc_id"]]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert by_text.keys() == whole.keys()
    for k, pieces in by_text.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0
            at += r["length"]
        assert at == len(whole[k])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_packing_equals_the_tokenizer_on_every_text(spark):
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = op12_packing(spark, SF).collect()
    assert check_packing(got, docs) == 0
    assert len(got) < 1.6 * len(docs)  # most texts stay whole


def test_words_are_looked_up_once():
    """Known words are looked up once per place and encoded once; letters of ASCII pass the short way to the same ids."""
    class Counted(dict):
        n = 0

        def get(self, key):
            Counted.n += 1
            return super().get(key)

        def __getitem__(self, key):
            Counted.n += 1
            return super().__getitem__(key)

    encoder, exact = packing.Encoder(packing.tokenizer_file()), Tokenizer.from_str(packing.tokenizer_file())
    texts = ["The cat's nap, naïve ÜBER  Straße 12th ab12!! <|startoftext|> don't", "word " * 50, "É é e\u0301 ΣΑΣ", "", None]
    for _ in range(2):
        got = encoder.texts([t if t is None else t.encode() for t in texts])
        exact.encode_special_tokens = True
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [exact.encode(t or "", add_special_tokens=False).ids for t in texts]
    encoder.known = Counted(encoder.known)
    encoder.texts([t if t is None else t.encode() for t in texts])
    assert Counted.n == sum(len((t or "").encode().split()) for t in texts)
    assert encoder.light.encode("cat nap", add_special_tokens=False).ids == exact.encode("cat nap", add_special_tokens=False).ids


def test_packing_of_odd_rows(spark, odd):
    words = ["", "İstanbul’s Σσς", "it's we'll '5x", "<|endoftext|> x", "été “wort”. a.b-c", "日本語 テスト", "\x1c \x85x", "ǅ ﬁ ½²"]
    texts = {i: t for i, t in enumerate([None, *words, prose(1, 20_000), prose(2, 40_000)])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    pieces = packing.packed(df.repartition(3), packing.tokenizer_file())
    assert check_packing(pieces.withColumn("ids_crc32", F.crc32("ids")).collect(), texts) == 0
    total = packing.packed(odd, packing.tokenizer_file()).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    n = {r["doc_id"]: r["n"] for r in total}
    one = packing.packed(odd.where("doc_id = 8").limit(1), packing.tokenizer_file()).first()["doc_tokens"]
    assert n[0] == n[1] == n[2] == 1 and n[8] == 3 * one and None in n


@pytest.mark.parametrize("kind", ["equal", "large", "small", "mixed", "one"])
def test_windows_stay_within_capacity(kind):
    rng = random.Random(kind)
    size = {"equal": lambda: 1500, "large": lambda: rng.randint(1100, 2048), "small": lambda: rng.randint(1, 9), "mixed": lambda: min(2048, int(rng.lognormvariate(6.4, 1)) + 1), "one": lambda: 1}[kind]
    pieces = [(i, 0, size()) for i in range(300)]
    for made in (packing.filled(pieces, packing.Packing()), packing.rest(pieces, packing.Packing())):
        covered = defaultdict(list)
        for w in made:
            assert sum(p[2] for p in w) <= 2048
            for d, s, n in w:
                covered[d].append((s, n))
        for d, _, n in pieces:
            at = 0
            for s, k in sorted(covered[d]):
                assert s == at
                at += k
            assert at == n
    assert all((t := sum(p[2] for p in w)) & (t - 1) == 0 for w in packing.rest(pieces, packing.Packing()))


def test_differencing_balances():
    rng = random.Random(3)
    pieces = [(i, 0, min(2048, int(rng.lognormvariate(6.4, 1)) + 1)) for i in range(380)]
    sums = [sum(p[2] for p in w) for w in packing.differenced(pieces, 120)]
    assert sum(sums) == sum(p[2] for p in pieces) and max(sums) - min(sums) < 0.12 * np.mean(sums)
    assert sorted(sum(p[2] for p in w) for w in packing.differenced([(i, 0, n) for i, n in enumerate([8, 7, 6, 5, 4])], 2)) == [14, 16]


def test_window_count_rises_beyond_capacity():
    cfg = packing.Packing(window=16, group=4, shift=0)
    made = packing.filled([(i, 0, n) for i, n in enumerate([11, 11, 11, 11, 11, 9])], cfg)
    assert max(sum(p[2] for p in w) for w in made) <= 16


# Runs


def plain_runs(words):
    x, seen = periodic_runs.numbers(words), {}
    for q in range(1, len(words) // 4 + 1):
        edge = np.diff(np.concatenate([[0], (x[:-q] == x[q:]).astype(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            if b - a + q >= max(6, 4 * q):
                seen.setdefault((int(a), int(b + q)), q)
    return sorted((a, b - a, q) for (a, b), q in seen.items())


def plain_digest(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    code = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and code is not None and code % 10 == 0:
        g = code // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs, gone = plain_runs(words), set()
    for a, length, q in runs:
        gone.update(range(a + q, a + length))
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *figures, h(lines), hashlib.sha256(kept).hexdigest()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_runs_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = sorted((plain_digest(*r) for r in docs.collect()), key=repr)
    assert rows_of(op13_periodic_runs(spark, SF)) == want
    assert sum(r[1] > 0 for r in want) > 50


@pytest.mark.parametrize("size", [16, 64, 4096])
def test_runs_across_tiles(spark, size):
    """Strings of few words are full of runs of all periods, nested and touching."""
    rng = random.Random(size)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 300))) for _ in range(30)]
    for _ in range(40):
        part = [rng.choice("abcd") for _ in range(rng.randint(1, 90))]
        texts.append(" ".join([*(rng.choice("ab") for _ in range(rng.randint(0, 99))), *part * rng.randint(3, 9), *part[: rng.randint(0, len(part))], *"xaab"]))
    texts += ["a " * 700, "a b " * 500 + "c " + "a b " * 500]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = periodic_runs.find(df, size=size).collect()
    assert {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in got} == {i: plain_runs(t.encode().split()) for i, t in rows}
    assert next(r["collapsed"] for r in got if r["doc_id"] == len(rows) - 2) == "a"


def test_runs_of_odd_rows(spark, odd):
    want = sorted((plain_digest(r[0], r[1]) for r in odd_rows()), key=repr)
    assert rows_of(QUERIES["runs"](odd)) == want


def test_tiles_cover_texts():
    for n in (0, 1, 4096, 4097, 9000, 70_000):
        octaves = defaultdict(list)
        for low, high, start, end in periodic_runs.tiles(n):
            for j in range(low, high + 1):
                octaves[j].append((start, end))
        assert set(octaves) >= set(range(max(n // 4, 1).bit_length()))
        for cores in octaves.values():
            assert cores[0][0] == 0 and cores[-1][1] == n and all(a[1] == b[0] for a, b in zip(cores, cores[1:]))


def test_registered_columns(spark):
    assert op11_merkle_manifest(spark, SF).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
