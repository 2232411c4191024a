"""Operators against brute force: similarity joins, schedules, passages, line frequency, Viterbi, the pipeline."""

import hashlib
import itertools
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weekloom.llm import mixing, near_dedup, quality_rules, substring_dedup, token_counts
from weekloom.session import stage

DOCS = "doc_id long, text string"
HOSTED = "doc_id long, text string, source string"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def split(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def shingles(text, size):
    w = split((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def linked(texts, size, percent=80):
    """Smallest member of each text's component, all pairs with a common shingle looked at."""
    sets = [shingles(t, size) for t in texts]
    at = list(range(len(texts)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    common = {}
    for who in holders.values():
        for pair in itertools.combinations(who, 2):
            common[pair] = common.get(pair, 0) + 1
    for (i, j), n in common.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            a, b = sorted((find(i), find(j)))
            at[b] = a
    return [find(i) for i in range(len(texts))]


def changed(words, n, rng, tag):
    w = list(words)
    for k in rng.sample(range(1, len(w) - 1), n):
        w[k] = f"{tag}{k}"
    return w


def test_near_dedup_finds_pairs_just_above_the_limit(spark):
    """300 pairs at a similarity of 0.80 to 0.86, and 100 just below it."""
    rng = random.Random(3)
    texts, above = [], 0
    while above < 300 or len(texts) < 800:
        base = prose(rng.random(), 120).split()
        other = changed(base, rng.randint(4, 8), rng, "x")
        a, b = shingles(" ".join(base), 2), shingles(" ".join(other), 2)
        s = len(a & b) / len(a | b)
        if (0.8 <= s < 0.86 and above < 300) or (0.74 < s < 0.8 and len(texts) - 2 * above < 200):
            above += s >= 0.8
            texts += [" ".join(base), " ".join(other)]
    want = linked(texts, 2)
    got = near_dedup.group(spark.createDataFrame(list(enumerate(texts)), DOCS), near_dedup.NearDedup(shingle=2)).collect()
    got = {r["doc_id"]: r["component_id"] for r in got}
    assert above == 300 and [got[k] for k in range(len(texts))] == want


@pytest.mark.parametrize("leaf", [4, 16, 1024])
def test_near_dedup_large_nodes_equal_brute_force(spark, leaf):
    """A drifting chain, a cloud of near copies of which some are refused by the centre, strangers, exact copies."""
    rng = random.Random(leaf)
    base = prose(5, 100).split()
    cloud = [" ".join(changed(base, rng.randint(0, 9), rng, f"y{k}")) for k in range(120)]
    drift, now = [], prose(6, 100).split()
    for k in range(40):
        now = changed(now, 2, rng, f"z{k}")
        drift.append(" ".join(now))
    texts = cloud + drift + [prose(50 + k, 60) for k in range(30)] + cloud[:10]
    rng.shuffle(texts)
    cfg = near_dedup.NearDedup(shingle=2, leaf=leaf, depth=5)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.group(spark.createDataFrame(list(enumerate(texts)), DOCS), cfg).collect()}
    assert [got[k] for k in range(len(texts))] == linked(texts, 2)


def plain_mix(rows, block):
    """(doc_id -> taken, first slot) of the golden schedule, by plain loops; targets as in the contract."""
    size = {d: len(split(t)) for d, t, _ in rows}
    names = sorted({s for *_, s in rows if s is not None}, key=lambda s: s.encode("utf-32-be")) + [None] * any(s is None for *_, s in rows)
    total = {s: sum(size[d] for d, _, x in rows if x == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, rest, open_ = {}, 1.5 * sum(total.values()), list(names)
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level >= 2 * total[s]]
        for s in full or open_:
            target[s] = 2.0 * total[s] if full else weight[s] * level
        rest -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in full] if full else []
    goal = {s: int(target[s] + 1e-9) for s in names}
    wanted, upto, edges = sum(goal.values()), 0, []
    for s in names:
        low, upto = upto, upto + goal[s]
        edges.append((int(low / wanted * 2**32), int(upto / wanted * 2**32), s))
    slots = {s: [] for s in names}
    for t in range(-(-wanted // block)):
        at = t * 2654435769 % 2**32
        for low, high, s in edges:
            if low <= at < high:
                slots[s].append((t, min(block, wanted - t * block)))
    out = {}
    for s in names:
        given, pos = sum(w for _, w in slots[s]), 0
        mine = [d for d, _, x in rows if x == s]
        for d in sorted(mine, key=lambda d: hashlib.md5(f"mix-1{d}".encode()).hexdigest()):
            n = size[d]
            taken = max(0, min(n, given - pos)) + max(0, min(n, given - pos - total[s]))
            out[d] = (taken, slots[s][pos // block][0] if taken else None)
            pos += n
    return out, target, total


def hosted(n, seed=0):
    rng = random.Random(seed)
    return [(k, prose(k, rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", "c", "é", None])) for k in range(n)]


def test_mix_equals_plain_schedule(spark):
    rows = hosted(400)
    want, target, total = plain_mix(rows, 64)
    df = spark.createDataFrame(rows, HOSTED)
    got = mixing.taken(df).collect()
    assert {r["doc_id"]: (r["taken"], r["first_slot"]) for r in got} == want
    pieces = mixing.schedule(df).groupBy("doc_id").agg(F.sum("_taken").alias("n"), F.min("_slot").alias("s")).collect()
    assert {r["doc_id"]: (r["n"], r["s"]) for r in pieces} == {d: v for d, v in want.items() if v[0]}
    source = {d: s for d, _, s in rows}
    for s in target:
        taken = sum(v[0] for d, v in want.items() if source[d] == s)
        assert abs(taken - target[s]) <= 3 * 64 and taken <= 2 * total[s]


def test_mix_follows_its_schedule(spark, monkeypatch):
    """Without slots nothing is taken; other points give another mix."""
    df = spark.createDataFrame(hosted(200), HOSTED)
    plain = sorted(mixing.taken(df).collect(), key=repr)
    point, slots = mixing.point, mixing.slots
    monkeypatch.setattr(mixing, "point", lambda t: (point(t) + F.lit(1 << 30)) % F.lit(mixing.CIRCLE))
    assert sorted(mixing.taken(df).collect(), key=repr) != plain
    monkeypatch.setattr(mixing, "point", point)
    monkeypatch.setattr(mixing, "slots", lambda *a: slots(*a).where("false"))
    assert mixing.taken(df).agg(F.sum("taken")).first()[0] == 0


def test_footer_with_links_is_found(spark):
    """A footer of long links on different texts; copies of one text count once."""
    footer = "see http://example.org/a/very/long/link http://example.org/another/long/link http://example.org/third"
    rows = [(k, f"{prose(k, 60)}\n{footer}", "h") for k in range(200)]
    rows += [(500 + k, f"{prose(999, 60)}\nonly copies hold this line", "h") for k in range(50)]
    got = {r["doc_id"]: r for r in quality_rules.rate(spark.createDataFrame(rows, HOSTED)).collect()}
    assert all(got[k]["n_frequent_lines"] == 1 and got[k]["kept"] for k in range(200))
    assert all(got[500 + k]["n_frequent_lines"] == 0 for k in range(50))


def test_documents_of_frequent_lines_are_rejected(spark):
    common = [prose(70 + k, 12) for k in range(5)]
    rows = [(k, "\n".join([prose(k, 20), *common]), "h") for k in range(30)] + [(99, prose(99, 80), "h")]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.rate(spark.createDataFrame(rows, HOSTED)).collect()}
    assert not any(got[k] for k in range(30)) and got[99]


@pytest.mark.parametrize("share", [0.95, 0.9, 0.84, 0.8, 0.7])
def test_passages_equal_all_stretches(share):
    """Words of all stretches of 80 per cent shared shingles that begin and end with a shared one."""
    cfg = substring_dedup.Passages()
    rng = np.random.default_rng(int(share * 100))
    for _ in range(40):
        shared = rng.random(160) < share
        sums = np.concatenate([[0], np.cumsum(shared)])
        want = np.zeros(160 + cfg.shingle - 1, bool)
        for lo in np.flatnonzero(shared):
            for hi in np.flatnonzero(shared) + 1:
                if hi - lo + cfg.shingle - 1 >= cfg.words and 100 * (sums[hi] - sums[lo]) >= cfg.percent * (hi - lo):
                    want[lo : hi + cfg.shingle - 1] = True
        got = np.zeros_like(want)
        for a, b in substring_dedup.passages(shared, cfg):
            got[a : b + 1] = True
        assert (got == want).all()


def dup_words(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), DOCS)
    return {r["doc_id"]: r for r in substring_dedup.find(rows).collect()}


@pytest.mark.parametrize("order", ["quotes first", "quotes between"])
def test_passages_behind_quotes_of_their_parts(spark, order):
    """Three other texts each quote 20 of the 60 words: before both holders, or between them."""
    quotes, holders, later = [], [], []
    for k in range(100):
        words = prose(5000 + k, 60).split()
        quotes += [f"{prose(8000 + 10 * k + j, 40)} {' '.join(words[20 * j : 20 * j + 20])} {prose(9000 + 10 * k + j, 40)}" for j in range(3)]
        holders.append(f"{prose(6000 + k, 50)} {' '.join(words)} {prose(6500 + k, 50)}")
        later.append(f"{prose(7000 + k, 30)} {' '.join(words)} {prose(7500 + k, 60)}")
    texts = [*quotes, *holders, *later] if order == "quotes first" else [*holders, *quotes, *later]
    got = dup_words(spark, texts)
    n = len(texts)
    assert [got[i]["n_dup_words"] for i in range(n - 100, n)] == [60] * 100
    assert all(got[i]["n_dup_words"] == 0 for i in range(n - 100))


def test_near_passages_are_found(spark):
    """Passages of 100 words with two to four words changed; at least nine of ten are found."""
    rng = random.Random(17)
    first, second = [], []
    for k in range(200):
        words = prose(20000 + k, 100).split()
        first.append(f"{prose(21000 + k, 60)} {' '.join(words)}")
        for at in rng.sample(range(5, 95), rng.randint(2, 4)):
            words[at] = "other"
        second.append(f"{' '.join(words)} {prose(22000 + k, 60)}")
    got = dup_words(spark, first + second)
    assert sum(got[200 + k]["n_dup_words"] >= 50 for k in range(200)) >= 180
    assert all(got[k]["n_dup_words"] == 0 for k in range(200))


def test_passages_behind_quotes_before_and_between(spark):
    """Each part of a passage is quoted by texts before both of its holders and by texts between them."""
    quotes, holders, later = ([], []), [], []
    for k in range(30):
        words = prose(45000 + k, 60).split()
        for side, own in enumerate(quotes):
            for j in range(3):
                n = 46000 + 100 * k + 10 * side + j
                own.append(f"{prose(n, 40)} {' '.join(words[20 * j : 20 * j + 20])} {prose(n + 5, 40)}")
        holders.append(f"{prose(50000 + k, 50)} {' '.join(words)} {prose(50500 + k, 50)}")
        later.append(f"{prose(51000 + k, 30)} {' '.join(words)} {prose(51500 + k, 60)}")
    got = dup_words(spark, [*quotes[0], *holders, *quotes[1], *later])
    n = len(got)
    assert [got[i]["n_dup_words"] for i in range(n - 30, n)] == [60] * 30
    assert all(got[i]["n_dup_words"] == 0 for i in range(n - 30))


def test_passage_of_one_holder_among_many_quotes(spark):
    """Hundreds of texts quote the parts; only the one in their midst holds the passage."""
    words = prose(52000, 60).split()
    quotes = [f"{prose(53000 + j, 40)} {' '.join(words[20 * (j % 3) : 20 * (j % 3) + 20])} {prose(54000 + j, 40)}" for j in range(300)]
    holder = f"{prose(55000, 40)} {' '.join(words)} {prose(55001, 40)}"
    got = dup_words(spark, [*quotes[:150], holder, *quotes[150:], f"{prose(55002, 40)} {' '.join(words)} {prose(55003, 40)}"])
    assert got[301]["n_dup_words"] == 60 and {p["other"] for p in got[301]["passages"]} == {150}
    assert all(got[i]["n_dup_words"] == 0 for i in range(301))


def test_passages_equal_plain_loops(spark):
    """Every word of a passage with any earlier text, on texts mixed from few sources with changed words."""
    cfg = substring_dedup.Passages()
    rng = random.Random(23)
    sources = [prose(60000 + k, 130).split() for k in range(3)]
    rows = []
    for d in range(140):
        words = prose(61000 + d, rng.randint(0, 30)).split()
        for _ in range(rng.randint(1, 3)):
            lo = rng.randrange(90)
            part = rng.choice(sources)[lo : lo + rng.randint(15, 100)]
            words += [w if rng.random() > 0.03 else f"x{rng.randrange(10**6)}" for w in part] + prose(62000 + rng.randrange(10**4), 4).split()
        rows.append((None if d == 0 else d - d % 7 if d % 7 == 1 else d, " ".join(words)))
    rows.append((200, f"{'same ' * 70}"))
    rows.append((201, f"{prose(63000, 60)} {'same ' * 60}"))
    size = cfg.words - cfg.shingle + 1
    texts, want = [], {}
    for d, text in rows:
        w = text.split()
        texts.append((-1 if d is None else d, [tuple(w[i : i + cfg.shingle]) for i in range(len(w) - cfg.shingle + 1)], len(w)))
    held = [(e, set(theirs), many) for e, theirs, many in texts]
    for d, mine, n in texts:
        inside = np.zeros(n, bool)
        for e, theirs, many in held:
            if e < d and many >= cfg.words and n >= cfg.words:
                hit = np.array([x in theirs for x in mine])
                sums = np.concatenate([[0], np.cumsum(hit)])
                for lo in np.flatnonzero(hit):
                    hi = np.flatnonzero(hit) + 1
                    hi = hi[(hi - lo >= size) & (100 * (sums[hi] - sums[lo]) >= cfg.percent * (hi - lo))]
                    if len(hi):
                        inside[lo : hi[-1] + cfg.shingle - 1] = True
        want.setdefault((d, n), []).append(int(inside.sum()))
    got = {}
    for r in substring_dedup.find(spark.createDataFrame(rows, DOCS)).collect():
        ends: dict = {}
        for p in r["passages"]:
            assert p["last"] > ends.get(p["other"], -1), "one contains another"
            ends[p["other"]] = p["last"]
        got.setdefault((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"]), []).append(r["n_dup_words"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert sum(map(sum, want.values())) > 1000


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_repeated_passages_equal_brute_force(spark, table):
    """Every word of a 50-word string that an earlier text holds is inside a passage."""
    docs = spark.read.parquet(f"/root/testdata/{table}/documents.parquet")
    got = {r["doc_id"]: r["passages"] for r in substring_dedup.find(docs).collect()}
    seen, missed, all_words = set(), 0, 0
    for r in docs.select("doc_id", "text").orderBy("doc_id").collect():
        w = split(r["text"])
        strings = [hash(tuple(w[i : i + 50])) for i in range(len(w) - 49)]
        held = np.zeros(len(w), bool)
        for i, s in enumerate(strings):
            if s in seen:
                held[i : i + 50] = True
        seen.update(strings)
        inside = np.zeros(len(w), bool)
        for p in got[r["doc_id"]]:
            inside[p["first"] : p["last"] + 1] = True
        missed += int((held & ~inside).sum())
        all_words += int(held.sum())
    assert all_words and missed == 0, (missed, all_words)


def test_chains_cross_ranges(spark):
    """One min-hash over many ranges: the links are those of one sorted list."""
    rows = [(5, d, 10 * d + k, 0) for d in range(300) for k in range(d % 3 + 1)] + [(v, v, v, 0) for v in (1, 9)]
    windows = spark.createDataFrame(rows, "_v long, _d long, _row long, _at long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["_row"], r["_e"]) for r in substring_dedup.links(stage(windows, "chain-test")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {(10 * d + k, e) for d in range(1, 300) for k in range(d % 3 + 1) for e in (0, d - 1)}
    assert want <= got and all(e < r // 10 for r, e in got)


def test_links_across_ranges_need_no_join(spark):
    """A min-hash of all ranges: the links of one sorted list and those to a range's first, each once, without a join."""
    n = 400
    windows = spark.createDataFrame([(5, d, d, d) for d in range(n)], "_v long, _d long, _row long, _at long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = substring_dedup.links(stage(windows, "chain-test"))
        got = sorted((r["_at"], r["_e"], r["_e_row"]) for r in made.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(set(got)) <= 3 * n and all(e == e_row < at for at, e, e_row in got)
    assert {(d, e, e) for d in range(1, n) for e in (0, d - 1)} <= set(got)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_token_counts_equal_plain_viterbi(spark):
    """Every text of the small table, by a Viterbi over dictionary look-ups instead of an automaton."""
    pieces = token_counts.vocabulary()
    score = {}
    for p, s in pieces:
        score.setdefault(p, s)
    longest, unknown = max(map(len, score)), min(score.values()) - 10.0

    def word(w):
        best = [(0.0, 0)]
        for end in range(1, len(w) + 1):
            top, single = None, w[end - 1] in score
            for start in range(max(0, end - longest), end):
                if (s := score.get(w[start:end])) is not None:
                    s += best[start][0]
                    if top is None or s > top[0]:
                        top = (s, best[start][1] + 1)
            if not single and (top is None or best[end - 1][0] + unknown > top[0]):
                top = (best[end - 1][0] + unknown, best[end - 1][1] + len(w[end - 1].encode()))
            best.append(top)
        return best[-1][1]

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.counted(docs, pieces).collect()}
    memo = {}
    for r in docs.collect():
        parts = (r["text"] or "").replace("▁", " ").split(" ") if r["text"] else []
        parts = parts[1:] if parts and parts[0] == "" else parts
        for w in parts:
            if w not in memo:
                memo[w] = word("▁" + w)
        assert got[r["doc_id"]] == sum(memo[w] for w in parts)


def plain_quality(rows):
    host, lines = {}, {}
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(LOWER)
    for r in rows:
        host.setdefault(r["source"], set()).add(r["text"] or "")
    for s, texts in host.items():
        for t in texts:
            for x in {key(x) for x in t.split("\n")} - {""}:
                lines[s, x] = lines.get((s, x), 0) + 1
    out = []
    for r in rows:
        w = split(r["text"])
        grams = list(zip(w, w[1:], w[2:]))
        twice = {g for g in grams if grams.count(g) > 1}
        again = {i + k for i, g in enumerate(grams) if g in twice for k in range(3)}
        lost = sum(
            len(split(x)) for x in (r["text"] or "").split("\n")
            if key(x) and lines[r["source"], key(x)] > max(10, 0.01 * len(host[r["source"]]))
        )
        if len(w) >= 50 and 100 * len(again) <= 50 * len(w) and lost <= 0.5 * len(w):
            out.append(r)
    return out


def plain_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(LOWER)
    seen, out = {}, []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        for x in r["text"].split("\n"):
            seen.setdefault(key(x), r["doc_id"])
        kept = [x for x in r["text"].split("\n") if len(key(x)) < 10 or seen[key(x)] == r["doc_id"]]
        out.append(r | {"text": "\n".join(kept)})
    return out


def test_pipeline_equals_plain_stages(spark):
    """run() on the small table: its first three stages and the mix by plain loops, decontamination by its windows."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    steps, now = {}, docs
    for name, step in corpus_pipeline.STAGES:
        now = stage(step(spark, now, sf), "test-stage")
        steps[name] = now.collect()
    texts = lambda found: {r["doc_id"]: r["text"] for r in found}
    good = plain_quality(rows)
    assert texts(steps["quality rules"]) == texts(good)
    lined = plain_lines(good)
    assert texts(steps["line dedup"]) == texts(lined)
    first = linked([r["text"] for r in lined], 2)
    near = [r for k, r in enumerate(lined) if first[k] == k]
    assert texts(steps["near dedup"]) == texts(near)
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = re.findall(pattern, (r["text"] or "").translate(LOWER))
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}
    cleaned = texts(steps["decontamination"])
    for r in near:
        w = re.findall(pattern, r["text"].translate(LOWER))
        hit = {k for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for k in range(i, i + n)}
        left = [x for k, x in enumerate(w) if k not in hit]
        if len(hit) > 0.5 * len(w):
            assert r["doc_id"] not in cleaned
        else:
            assert re.findall(pattern, cleaned[r["doc_id"]].translate(LOWER)) == left
            assert hit or cleaned[r["doc_id"]] == r["text"]
    last = [(r["doc_id"], r["text"], r["source"]) for r in steps["decontamination"]]
    want, _, _ = plain_mix(last, 64)
    assert {r["doc_id"]: (r["taken"], r["first_slot"]) for r in steps["mix"]} == want
    assert sorted(map(repr, corpus_pipeline.run(spark, sf).collect())) == sorted(map(repr, steps["mix"]))
