"""Operators against brute force and on edge cases: nulls, empty texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import math
import random
import textwrap
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

import corpus_pipeline
from weekloom.llm import (
    decontaminate,
    html_extract,
    license_scan,
    line_dedup,
    mixing,
    near_dedup,
    quality_rules,
    substring_dedup,
    suffix_dedup,
    token_counts,
)
from weekloom.llm.words import LETTERS, Words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row int, _k1 string, kept string"
BENCH = "item_id long, text string"
OPERATORS = {
    "license": lambda s, d: license_scan.scan(license_scan.document_files(d)),
    "decontaminate": lambda s, d: decontaminate.scan(d, s.createDataFrame([(1, "a b c"), (None, None)], BENCH)),
    "quality": lambda s, d: quality_rules.rate(d),
    "tokens": lambda s, d: token_counts.counted(d, token_counts.vocabulary()),
    "lines": lambda s, d: line_dedup.digest(d),
    "near": lambda s, d: near_dedup.group(d),
    "passages": lambda s, d: substring_dedup.find(d),
    "mix": lambda s, d: mixing.taken(d),
    "suffix": lambda s, d: suffix_dedup.removed(d),
    "html": lambda s, d: html_extract.extract(
        d.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    ),
}
STAGES = {
    "quality": lambda s, d: quality_rules.keep(d),
    "lines": lambda s, d: line_dedup.apply(d),
    "near": lambda s, d: near_dedup.keep_first(d),
    "decontaminate": lambda s, d: decontaminate.clean(d, s.createDataFrame([], BENCH)),
    "near of two words": lambda s, d: near_dedup.keep_first(d, near_dedup.NearDedup(shingle=2)),
}


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    long = prose(1, 3000)
    texts = [None, "", " \n ", "one", long, long, prose(2, 80), "ä ö\n" * 40, prose(2, 80)]
    rows = [(i, t, None, "s" if i % 3 else None, 1, 5, "x", "y") for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "null id " * 30, None, None, None, None, None, None), (None,) * 8]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_input_row(spark, odd, name):
    assert OPERATORS[name](spark, odd).count() == odd.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stage_keeps_columns(spark, odd, name):
    out = STAGES[name](spark, odd)
    assert out.columns == odd.columns and 0 < out.count() <= odd.count()
    assert STAGES[name](spark, spark.createDataFrame([], SCHEMA)).count() == 0


def plain_suffix(rows, size):
    first = {}
    for d, t in rows:
        for i in range(len(t) - size + 1):
            first[t[i : i + size]] = min(d, first.get(t[i : i + size], d))
    out = {}
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if first[t[i : i + size]] < d:
                gone[i : i + size] = b"\1" * size
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[d] = (len(t), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("group", [256, 2])
def test_suffix_dedup_is_exact(spark, group):
    rng = random.Random(5)
    base = [prose(k, 60) for k in range(6)]
    texts = []
    for _ in range(60):
        a, b = rng.choice(base), rng.choice(base)
        i, j = rng.randrange(200), rng.randrange(200)
        texts.append(a[i : i + rng.randint(0, 150)] + "é" * rng.randint(0, 60) + b[j : j + rng.randint(0, 150)])
    rows = list(enumerate(texts))
    got = suffix_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string"), group=group).collect()
    want = plain_suffix([(d, t.encode()) for d, t in rows], 50)
    assert {r[0]: (r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in got} == want


def test_surroundings_hold_the_strings_that_name_their_anchor():
    text = (prose(3, 400) + "xyxyxyxyxy" * 30).encode()
    batch = pa.RecordBatch.from_pydict({"_d": [7], "_t": [0], "_text": pa.array([text.decode()])})
    every = np.full(2 ** (suffix_dedup.MAP_BITS - 6), 2**64 - 1, np.uint64)
    rows = [r for b in suffix_dedup._around(iter([batch]), 50, every, every) for r in b.to_pylist()]
    named = [set() for _ in range(len(text) - 49)]
    for r in rows:
        first = r["_at"] - r["_ctx"][0]
        assert r["_ctx"][1:] == text[first : first + len(r["_ctx"]) - 1]
        for p in range(first, first + len(r["_ctx"]) - 50):
            named[p].add(r["_h"])
    # Every string travels, with one anchor's surroundings: not with those of its neighbours too.
    assert all(len(x) == 1 for x in named)


def test_equal_surroundings_do_not_travel(spark):
    same, left = prose(11, 60), prose(12, 60)
    rows = [(d, left[d : d + 40] + same) for d in (4, 2, 9)]
    batch = pa.RecordBatch.from_pydict({"_d": [d for d, _ in rows], "_t": [0] * 3, "_text": [t for _, t in rows]})
    every = np.full(2 ** (suffix_dedup.MAP_BITS - 6), 2**64 - 1, np.uint64)
    places = pa.Table.from_batches(suffix_dedup._around(iter([batch]), 50, every, every)).to_pandas().sort_values("_h", kind="stable")
    before = places["_ctx"].map(lambda c: c[0])
    places["_left"], places["_right"] = before.astype("int32"), (places["_ctx"].map(len) - 1 - before).astype("int32")
    mixed = np.zeros(2 ** (suffix_dedup.MAP_BITS - 6), np.uint64)
    for h, g in places.groupby("_h")["_ctx"]:
        if g.nunique() > 1:
            s = int(h) & (2**suffix_dedup.MAP_BITS - 1)
            mixed[s >> 6] |= np.uint64(1 << (s & 63))
    whole = pa.RecordBatch.from_pandas(places, preserve_index=False)
    (slim,) = suffix_dedup._needed(iter([whole]), mixed)
    assert 0 < slim.column("_ctx").null_count < len(places)
    reached = lambda b: [r for x in suffix_dedup._reach(iter([b]), 50, "_d", ["_d", "_at"]) for r in x.to_pylist()]
    assert reached(slim) == reached(whole.drop_columns(["_left", "_right"]))


def test_spans_are_merged_before_they_meet_the_texts():
    rng = random.Random(8)
    spans = [[{"a": (a := rng.randrange(200)), "b": a + rng.randint(1, 9)} for _ in range(rng.randint(0, 30))] for _ in range(50)]
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    ids = pa.array(range(50), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(spans, kind)], names=["_d", "_t", "_spans"])
    got = [r for part in (batch.slice(0, 20), batch.slice(20)) for b in suffix_dedup._merged(iter([part])) for r in b.to_pylist()]
    assert [r["_d"] for r in got] == list(range(50))
    for mine, r in zip(spans, got):
        assert {x for s in mine for x in range(s["a"], s["b"])} == {x for s in r["_spans"] for x in range(s["a"], s["b"])}
        assert all(s["b"] < t["a"] for s, t in zip(r["_spans"], r["_spans"][1:]))


def test_deep_shallow_sorts():
    rng = random.Random(2)
    text = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(300)})
    assert [text[i] for i in suffix_dedup.deep_shallow(text)] == sorted(text)


def test_near_dedup_blocks_of_large_nodes(spark):
    """Tiny leaves: branching and pairs of blocks still find every link of a group of near copies."""
    rng = random.Random(4)
    words = prose(9, 60).split()
    texts = []
    for _ in range(60):
        w = list(words)
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [prose(100 + k, 60) for k in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cfg = near_dedup.NearDedup(shingle=2, leaf=4, depth=4, trees=8)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.group(df, cfg).collect()}
    assert {d: c for d, c in got.items() if d < 60} == dict.fromkeys(range(60), 0)
    assert all(got[d] == d for d in range(60, 80))


def test_decontaminate_groups_of_items(spark):
    items = [(k, prose(50 + k, 14)) for k in range(8)] + [(99, "short one")]
    docs = [(k, f"{prose(k, 30)} {items[k][1]} {prose(k + 40, 30)}") for k in range(8)] + [(8, "a short one."), (9, "x")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, BENCH)
    whole = sorted(decontaminate.scan(d, b).collect())
    assert sorted(decontaminate.scan(d, b, max_bytes=200).collect()) == whole
    assert [r["n_hit"] for r in whole] == [14] * 8 + [2, 0]
    clean = {r[0]: r[1] for r in decontaminate.clean(d, b).collect()}
    assert clean[0].split() == (prose(0, 30) + " " + prose(40, 30)).split() and clean[9] == "x" and 8 not in clean


def test_token_counts_equal_the_tokenizer(spark):
    pieces = token_counts.vocabulary()
    exact = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    exact.pre_tokenizer = pre_tokenizers.Metaspace()
    counter = token_counts.Counter(pieces)
    for text in ["", " ", "a  b", " x", "▁y z▁", "日本語😀 \x00", prose(1, 50), "ab" * 500]:
        assert counter.text(text) == len(exact.encode(text, add_special_tokens=False).ids)


def test_html_extract_on_held_out_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").limit(120).collect()
    model = html_extract.Model().fit([r["html"] for r in pages[:60]])
    for r in pages[60:]:
        nodes = html_extract.parse(r["html"])
        y = html_extract.labels(nodes)
        assert model.extract(r["html"]) == "\n".join(n.text for n, k in zip(nodes, y) if n.tag == "#text" and k)


def test_html_extract_without_article():
    page = (
        "<body><header><a href=x>Home</a> Name</header><div class='cookie-notice'><p>We use cookies on this site to give you "
        "the best experience that is possible, accept?</p></div><div id=content><h1>Title</h1><p>Hello   world &amp; all.<p>Short."
        "</div><div class=sidebar><ul><li><a href=y>Link</a></ul></div><section id=comments><p>Nice article, I have read it with "
        "great interest and would like to comment at length.</p></section><form>Mail <input></form></body>"
    )
    assert html_extract.Model().extract(page) == "Title\nHello world & all.\nShort."


def test_license_inheritance(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/c/x.py", "code"),
        (3, "a/b/LICENSE", "Licensed under CC BY-NC 4.0."),
        (4, "a/y.py", "code\nLicensed under the Apache License, Version 2.0.\n" + prose(1, 50)),
        (5, "z/y.py", None),
        (6, None, "x"),
    ]
    got = {r["id"]: (r["licence"], r["origin"]) for r in license_scan.scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    assert got == {
        1: ("mit", "file"),
        2: ("cc-by-nc-4.0", "inherited"),
        3: ("cc-by-nc-4.0", "file"),
        4: ("apache-2.0", "header"),
        5: (None, None),
        6: (None, None),
    }


def test_license_headers_and_files(spark):
    """Whole headers in comment blocks, whole licence files, and titles of long ones by the file's name."""
    gpl = license_scan.gnu("GNU General Public License", "3")
    wrapped = textwrap.wrap(" ".join(gpl.split()), 70)
    mit = license_scan.TEMPLATES["mit"][1]
    rows = [
        (1, "p/a.c", "/* Copyright (C) 2020 Jane Doe\n * \n" + "\n".join(f" * {x}" for x in wrapped) + "\n */\nint main;\n" * 30),
        (2, "p/b.py", "\n".join(f"# {x}" for x in wrapped) + "\nimport os\n" + "x = os.name\n" * 50),
        (3, "q/LICENSE", "MIT License\n\nCopyright (c) 2021 Jane Doe\n\n" + "\n".join(textwrap.wrap(" ".join(mit.split()), 78))),
        (4, "q/src/c.py", "y = 2\n" * 20),
        (5, "r/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n" + prose(3, 3000)),
        (6, "r/deep/er/d.py", prose(4, 40)),
        (7, "r/notes.txt", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\n" + prose(5, 300)),
        (8, "s/e.py", prose(6, 40)),
        (9, "q/src/c.py", "y = 2\n" * 20),
    ]
    found = license_scan.scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()
    got = {r["id"]: (r["licence"], r["origin"]) for r in found}
    assert got == {
        1: ("gpl-3.0", "header"),
        2: ("gpl-3.0", "header"),
        3: ("mit", "file"),
        4: ("mit", "inherited"),
        5: ("gpl-3.0", "file"),
        6: ("gpl-3.0", "inherited"),
        7: ("gpl-3.0", "header"),
        8: (None, None),
        9: ("mit", "inherited"),
    }


def test_license_scan_equals_brute_force(spark):
    """Cosine of every line, block and text of the small table by dictionaries, inheritance by walking up."""
    files = license_scan.document_files(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    rows, got = files.collect(), {r["id"]: r for r in license_scan.scan(files).collect()}
    tokens = lambda t: Words([t.encode()], LETTERS).hash.tolist()
    forms = [(n, Counter(tokens(t))) for n, of in sorted(license_scan.TEMPLATES.items()) for t in ([of] if isinstance(of, str) else of)]
    n = len(forms)
    held = Counter(w for _, bag in forms for w in bag)
    idf = lambda w: math.log((1 + n) / (1 + held[w])) + 1
    size = lambda bag: math.sqrt(sum((c * idf(w)) ** 2 for w, c in bag.items()))

    def best(text):
        bag = Counter(tokens(text))
        if not bag:
            return 0.0
        return max(sum(c * bag[w] * idf(w) ** 2 for w, c in form.items()) / size(form) / size(bag) for _, form in forms)

    def parts(text):
        out, kind = [], None
        for line in text.split("\n"):
            bare = line.strip()
            now = None if not bare else bare.startswith(("#", "*", ";", "%", "//", "/*", "--", "<!"))
            if now is None or now != kind:
                out.append([])
            out[-1].append(line)
            kind = now
        return text.split("\n") + ["\n".join(x) for x in out]

    whole = {r["id"]: best(r["text"] or "") >= 0.8 for r in rows}
    dirs = {r["path"].rsplit("/", 1)[0] for r in rows if whole[r["id"]]}
    for r in rows:
        up = r["path"].split("/")[:-1]
        above = any("/".join(up[:k]) in dirs for k in range(len(up) + 1))
        header = max(map(best, parts(r["text"] or ""))) >= 0.8
        assert got[r["id"]]["origin"] == ("file" if whole[r["id"]] else "header" if header else "inherited" if above else None)


def test_passages_are_found(spark):
    shared, near = prose(7, 60), prose(8, 80).split()
    changed = list(near)
    changed[20] = changed[60] = "other"
    rows = [
        (1, f"{prose(1, 40)} {shared} {prose(2, 40)}"),
        (2, f"{prose(3, 90)} {shared}"),
        (3, f"{prose(4, 30)} {' '.join(near)} {prose(5, 20)}"),
        (4, f"{prose(6, 10)} {' '.join(changed)}"),
        (5, prose(9, 300)),
    ]
    got = {r["doc_id"]: r for r in substring_dedup.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2]["n_dup_words"] == 60 and got[2]["passages"][0]["other"] == 1
    assert got[4]["n_dup_words"] == 80
    assert [got[d]["n_passages"] for d in (1, 3, 5)] == [0, 0, 0]


def test_mix_schedule_is_even(spark):
    rows = [(i, "w " * 50, f"s{i % 3}") for i in range(300)]
    mix = mixing.schedule(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=25)
    order = [r["_no"] for r in mix.select("_slot", "_no").distinct().orderBy("_slot").collect()]
    share = {k: order.count(k) / len(order) for k in set(order)}
    for n in range(50, len(order), 50):
        assert all(abs(order[:n].count(k) - share[k] * n) < 5 for k in share)


def test_pipeline_stages_hand_on_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    last = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules"
    assert 0 < last.count() <= docs.count()


def test_line_dedup_across_ranges(spark):
    """One line in every document, more ranges than documents with it: first occurrences are settled over all ranges."""
    rng = random.Random(6)
    common = [f"a very common line {k}" for k in range(4)]
    rows = []
    for d in range(120):
        own = [prose(d * 7 + k, 4) + " own" for k in range(2)]
        rows.append((d, "\n".join(rng.sample(common, rng.randint(0, 4)) * rng.randint(1, 2) + own)))
    rows += [(None, common[0]), (5, common[1] + "\nshort"), (200, None)]
    seen, want = {}, []
    for d, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        for line in (t or "").split("\n"):
            seen.setdefault(line, -1 if d is None else d)
    for d, t in rows:
        kept = [x for x in (t or "").split("\n") if len(x) < 10 or seen[x] == (-1 if d is None else d)]
        want.append((d, (t or "").count("\n") + 1, (t or "").count("\n") + 1 - len(kept), "\n".join(kept)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = line_dedup.plan(df).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
