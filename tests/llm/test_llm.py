"""Corpus operators against brute force on small tables with nulls, empty and long texts, ties,
repeated rows, empty tables and extra columns."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import blocks, common, contamination, graph, licenses, lines, near, packing, quality, sharding, substrings, tokens, train_blocks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot string, _n string"
UP = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def corpus():
    r = random.Random(4)
    vocab = ["".join(r.choices("abcdefghé", k=r.randint(1, 6))) for _ in range(400)]
    text = lambda n: " ".join(r.choices(vocab, k=n))
    base = [text(r.randint(20, 120)) for _ in range(25)]
    out = [*base]
    for b in base[:8]:
        for _ in range(4):
            w = b.split()
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocab)
            out.append(" ".join(w))
    out += [base[0].upper().replace("É", "é")] * 3 + ["one two", "One  TWO", "", "   \n ", None, text(9000), "É" * 30]
    passage = text(60)
    out += [text(10) + "\n" + passage + "\n" + text(8) for _ in range(5)]
    out += ["shared line here\n" + text(12) + "\n\tSHARED line here \n" for _ in range(12)]
    return out


@pytest.fixture(scope="module")
def rows():
    texts = corpus()
    made = [(i * 3 % 101 + 200 * (i // 101), t, "en", "hot" if i % 3 else f"s{i}", len(t) if t else None, "x", "y", "z") for i, t in enumerate(texts)]
    made[5] = (made[5][0], made[5][1], None, None, None, None, None, None)
    return [*made, made[3], (None, "a text without an id at all, longer than ten words it is indeed", "en", "s", 5, "", "", "")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(t, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, t or "")


def shingle_set(t):
    w = words_of((t or "").translate(UP))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


# --- kernels ----------------------------------------------------------------------------------


def test_hashed_words_segments(monkeypatch):
    texts = [b"ab cd  ab", b"", b" x ", b"cd " * 50 + b"ab"]
    whole, cut = common.hashed_words(texts, common.BLANKS)
    monkeypatch.setattr(common, "SEGMENT", 16)
    parts, cut2 = common.hashed_words(texts, common.BLANKS)
    assert (whole == parts).all() and (cut == cut2).all() and list(np.diff(cut)) == [3, 0, 1, 51]
    assert whole[0] == whole[2] and whole[0] != whole[1] and whole[-1] == whole[0]


def test_ordered_parts():
    rng = np.random.default_rng(5)
    part = np.sort(rng.integers(0, 40, 3000))
    for s in (rng.integers(0, 2**64, 3000, dtype=np.uint64), rng.integers(0, 90, 3000, dtype=np.uint64)):  # those of 90 differ in their lowest bits only
        order = common.ordered_parts(part, s, 40)
        want = np.lexsort((s, part))
        assert (part[order] == part[want]).all() and (s[order] == s[want]).all() and len(set(order.tolist())) == 3000


def test_parts_are_signed_without_a_sort_by_two_keys(monkeypatch):
    """It took most of the time of op5's first pass over the texts."""
    rng = np.random.default_rng(6)
    words = rng.integers(1, 2**60, 500, dtype=np.uint64)
    words[100:200] = words[300:400]
    monkeypatch.setattr(np, "lexsort", None)
    node, _, size = substrings.signed(words, np.array([0, 100, 300, 20]), np.array([100, 200, 400, 120]), 5, 4)
    assert node[1] == node[2] and len(set(node.tolist())) == 3 and size.tolist() == [96] * 4
    assert near._intersections([np.array([1, 5, 9], np.uint64) << np.uint64(50)] * 2, [np.array([5, 9], np.uint64) << np.uint64(50), np.array([7], np.uint64)]).tolist() == [2, 0]


def test_shingle_sets():
    texts = ["a b c d e f a b c d e", None, "", "one two", "x " * 40, "A b C d E", " \n "]
    got = list(near.shingle_sets(texts, 5))
    assert [len(x) for x in got] == [len(shingle_set(t)) for t in texts] and all((np.diff(x.astype(object)) > 0).all() for x in got)
    assert got[5][0] in got[0] and all((x == y).all() for t, x in zip(texts, got, strict=True) for y in near.shingle_sets([t], 5))


def test_maybe_in(spark):
    ids = spark.range(0, 6000, 3)
    rows = spark.range(200_000).selectExpr("id as x", "if(id % 5 = 0, null, id) as y")
    got = [r["y"] for r in common.maybe_in(rows, F.col("y"), ids).collect()]
    want = {i for i in range(0, 6000, 3) if i % 5}
    assert want <= set(got) and len(got) < len(want) + 40
    plan = common.maybe_in(rows, F.col("y"), ids)._jdf.queryExecution().optimizedPlan().toString()
    assert "substring(_bits" not in plan  # that copies 4 KB for each row


def test_slots(spark):
    df = spark.createDataFrame([(g, i) for g in ("a", "b") for i in range(50)] + [("a", 3)], "g string, i long")
    got = common.slots(df, "g", ["i"]).collect()
    for g in "ab":
        assert sorted(r["slot"] for r in got if r["g"] == g) == list(range(sum(r["g"] == g for r in got)))


# --- 1 ----------------------------------------------------------------------------------------


def test_sharding(docs, rows, empty):
    got = sharding.shard(docs, shards=6).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    # a document of more than a shard's share leaves others empty, as it can't be split
    most = max(r["size"] for r in got)
    assert set(size) <= set(range(6)) and max(size.values()) <= sum(size.values()) / 6 + most
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    for s in size:
        slot = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slot == list(range(len(slot)))
    assert sharding.shard(empty, shards=6).collect() == []


def test_sharding_hot_value_and_target(spark):
    df = spark.createDataFrame([(i, "x" * 10, "en", "hot", 10) for i in range(600)], "doc_id long, text string, lang string, source string, n_chars long")
    n = collections.Counter(r["shard"] for r in sharding.shard(df, shards=None, target_bytes=1800, dims=("source", "lang")).collect())
    assert len(n) == 6 and max(n.values()) - min(n.values()) <= 40


def test_sharding_to_target_bytes(spark):
    r = random.Random(3)
    made = [(i, "x" * r.choice([1, 5, 40, 300]), "en", f"s{i % 5}", i) for i in range(400)] + [(1000, "y" * 9000, "en", "s1", 9000), (1001, "y" * 9000, "en", "s1", 9000)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    got = sharding.shard(df, shards=None, target_bytes=2500).collect()
    held = collections.defaultdict(list)
    for x in got:
        held[x["shard"]].append(x["size"])
    assert len(got) == len(made) and set(held) == set(range(len(held)))
    assert all(sum(v) <= 2500 or 9008 in v for v in held.values())
    assert len(held) <= 4 * sum(x["size"] for x in got) / 2500


# --- 2 ----------------------------------------------------------------------------------------


def brute_components(rows):
    ids = [(i, shingle_set(t)) for i, t, *_ in rows]
    parent = {i: i for i, _ in ids if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, s) in enumerate(ids):
        for j, u in ids[:k]:
            both = len(s & u)
            if i is not None and j is not None and s and u and 100 * both >= 75 * (len(s) + len(u) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


@pytest.mark.parametrize("short", [40, 2])
def test_near_duplicates(docs, rows, empty, short, monkeypatch):
    monkeypatch.setattr(near, "SHORT", short)
    monkeypatch.setattr(near, "PAIRS_PER_COPY", 2)
    got = near.near_duplicates(docs).collect()
    want = brute_components(rows)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == want[r["doc_id"]])
    sizes = collections.Counter((i, len(shingle_set(t))) for i, t, *_ in rows)
    assert collections.Counter((r["doc_id"], r["n_shingles"]) for r in got) == sizes
    assert near.near_duplicates(empty).collect() == []


def test_large_near_group(spark, monkeypatch):
    """Copies at many distances from one original: links inside long lists, block by block."""
    monkeypatch.setattr(near, "SHORT", 4)
    monkeypatch.setattr(near, "BLOCK_ROWS", 20)
    r = random.Random(1)
    base = [f"w{r.randrange(9999)}" for _ in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randint(0, 14)):
            w[r.randrange(120)] = f"v{r.randrange(9999)}"
        rows.append((i, " ".join(w)))
    got = {x["doc_id"]: x["component_id"] for x in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_match_threshold_and_counts():
    m = near.match_threshold(0.75)
    assert 25 <= m <= 34
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (5, 80, 200, 1)]
    got = near.shared_counts(sets[:2], sets[2:], wide=16)
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets[:2]]).all()


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(e, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}


# --- 3 ----------------------------------------------------------------------------------------


def features_of(t):
    t = t or ""
    w = words_of(t)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {p for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    full = [x for x in t.split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(hit)


def test_quality(docs, rows, empty, spark):
    got = quality.judged(docs).collect()
    want = collections.Counter((i, *features_of(t)) for i, t, *_ in rows)
    assert collections.Counter((r["doc_id"], *(r[c] for c in quality.BASE)) for r in got) == want
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert quality.judged(empty).collect() == []
    kept = quality.filtered(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["rejected_by"] is None for r in got)
    junk = ["a%%% b### c*** " * 30, "SHOUT!! LOUD!! " * 1 + " ".join(f"AB{c}CD!!" for c in "QWERTYUIOP"), "same line again\n" * 30, "dog dog dog dog dog cat cat cat cat cat the the the the the sun sun sun sun sun"]
    assert quality.filtered(spark.createDataFrame([(i, t) for i, t in enumerate(junk)], "doc_id long, text string")).count() == 0


def test_rule_order_does_not_change_verdicts(docs):
    a = quality.judged(docs, order=list(quality.RULES)).select("doc_id", "n_words", "kept").collect()
    b = quality.judged(docs, order=list(quality.RULES)[::-1]).select("doc_id", "n_words", "kept").collect()
    assert collections.Counter(map(tuple, a)) == collections.Counter(map(tuple, b))
    assert sorted(quality.rule_order(docs)) == sorted(quality.RULES)


# --- 4 ----------------------------------------------------------------------------------------


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UP)


def test_lines_common(docs, rows, empty):
    seen = collections.defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            seen[key_of(x)].add(i)
    hot = {k for k, v in seen.items() if k and len(v) >= 10}
    assert hot
    got = lines.apply(docs, lines.keep_bitmaps(docs, mode="common", min_docs=10)).select("doc_id", "text", "_n_lines", "_dropped").collect()
    want = collections.Counter()
    for i, t, *_ in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if key_of(x) not in hot]
        want[i, "\n".join(kept) if len(kept) < len(ls) else t, len(ls), len(ls) - len(kept)] += 1
    assert collections.Counter(map(tuple, got)) == want
    assert lines.keep_bitmaps(empty).collect() == []


def test_lines_first(spark):
    long = "\n".join(f"line {i % 150}" for i in range(300))
    rows = [(1, "a\nb\nA "), (2, "b\nc\n\n"), (3, None), (4, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.apply(docs, lines.keep_bitmaps(docs, mode="first")).collect()}
    assert got == {1: "a\nb", 2: "c\n\n", 3: None, 4: "\n".join(f"line {i}" for i in range(150))}


# --- 5 ----------------------------------------------------------------------------------------


def test_bands():
    r, b = substrings.bands(0.75)
    assert 1 - (1 - 0.75**r) ** b >= 0.9999 and r * b <= near.K


def low(t):
    return words_of((t or "").translate(UP))


def blocks_of(t, least):
    """(start, n) of the lines and blocks of ``least`` words or more."""
    out, at, block = set(), 0, None
    for line in [*(t or "").split("\n"), ""]:
        n = len(words_of(line))
        if n >= least:
            out.add((at, n))
        if n:
            block = at if block is None else block
        elif block is not None:
            out |= {(block, at - block)} if at - block >= least else set()
            block = None
        at += n
    return out


def similar(a, b, width=5):
    s, u = ({tuple(x[i : i + width]) for i in range(max(1, len(x) - width + 1))} for x in (a, b))
    return 100 * len(s & u) >= 75 * len(s | u)


def check_substrings(frame, got, least=50):
    """Every word of every shared run of ``least`` words is covered, similar lines and blocks are in one
    cluster, nothing else is reported, and each cluster stays once."""
    held = collections.defaultdict(set)
    name = {(i, th): t for i, th, t in frame.selectExpr("doc_id", "xxhash64(coalesce(text, ''))", "coalesce(text, '')").collect()}
    texts = {(i, t) for (i, _), t in name.items()}
    for i, t in texts:
        w = low(t)
        for k in range(len(w) - least + 1):
            held[tuple(w[k : k + least])].add(i)
    places = collections.defaultdict(set)
    for x in got:
        places[x["doc_id"], x["th"]].add((x["start"], x["n_words"], x["cluster"]))
    back = collections.defaultdict(list)
    for k, t in name.items():
        back[k[0], t].append(k)
    for i, t in texts:
        w = low(t)
        want = {p for k in range(len(w) - least + 1) if len(held[tuple(w[k : k + least])]) > 1 for p in range(k, k + least)}
        mine = {p for k in back[i, t] for s, n, _ in places[k] for p in range(s, s + n)}
        assert want <= mine, (i, sorted(want - mine)[:5])
    paras = [(i, t, s, n) for i, t in texts for s, n in blocks_of(t, least)]
    cluster = {(i, t, s, n): c for (i, t), ks in back.items() for k in ks for s, n, c in places[k]}
    for a in paras:
        for b in paras:
            if a[0] != b[0] and similar(low(a[1])[a[2] : a[2] + a[3]], low(b[1])[b[2] : b[2] + b[3]]):
                assert cluster[a] == cluster[b]
    groups = collections.defaultdict(list)
    for (i, t, s, n), c in cluster.items():
        groups[c].append((i, low(t)[s : s + n]))
    for g in groups.values():
        for i, w in g:
            own = {tuple(w[k : k + least]) for k in range(len(w) - least + 1)}
            assert any(j != i and (similar(w, v) or own & {tuple(v[k : k + least]) for k in range(len(v) - least + 1)}) for j, v in g) or any(j == i and v != w and similar(w, v) for j, v in g)
    order = lambda i: (i is not None, i or 0)
    for c in groups:
        ids = {x["doc_id"] for x in got if x["cluster"] == c}
        keeps = min(ids, key=order)
        assert {x["cluster_id"] for x in got if x["cluster"] == c} == {keeps} and {x["n_docs"] for x in got if x["cluster"] == c} == {len(ids)}
        assert {x["doc_id"] for x in got if x["cluster"] == c and not x["removed"]} == {keeps}


def test_substrings(docs, rows, empty):
    got = substrings.repeated(docs).collect()
    check_substrings(docs, got)
    assert len({x["cluster"] for x in got}) > 3 and substrings.repeated(empty).collect() == []


@pytest.mark.parametrize("seed", range(2))
def test_substrings_on_families(spark, seed):
    r = random.Random(seed)
    fresh = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    broken = lambda w: " ".join(x + ("\n" if r.random() < 0.06 else "\n\n" if r.random() < 0.03 else "") for x in w)
    known = [fresh(r.choice([49, 50, 51, 55, 70, 120])) for _ in range(8)]
    base = fresh(260)
    texts = []
    for _ in range(25):
        w = []
        for _ in range(r.randint(1, 4)):
            p = list(r.choice(known))
            if r.random() < 0.3:
                p[r.randrange(len(p))] = "edited"
            w += fresh(r.choice([0, 3, 40])) + p
        texts.append(broken(w))
    for _ in range(12):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(["x", "y"])
        texts.append(" ".join(w) if r.random() < 0.5 else broken(w))
    texts += [" ".join(["na"] * r.randint(60, 150)) for _ in range(3)] + [" ".join(["ha", "ho"] * 50 + fresh(20)), " ".join(["ho", "ha"] * 40)]
    texts += [texts[3], texts[3].upper(), texts[30], broken(known[4] + fresh(30) + known[4]), None, ""]
    rows = list(enumerate(texts)) + [(2, texts[2]), (7, texts[8]), (None, texts[0])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check_substrings(frame, substrings.repeated(frame).collect())


def passage_cases():
    """{name: ({doc: text}, {doc: words that are repeated})}, no words in common."""
    r = random.Random(21)
    fresh = lambda n: " ".join(f"w{r.randrange(10**9)}" for _ in range(n))
    span = lambda *ab: set().union(*(range(a, b) for a, b in ab))
    out = {}
    p = fresh(51)
    texts = {i: f"{fresh(20)}\n{fresh(3 * i)} {p} {fresh(40)}\n{fresh(9)}" for i in range(1, 6)} | {6: p, 7: fresh(300), 8: f"{fresh(60)}\n{fresh(60)}", 9: f"{p.rsplit(' ', 30)[0]} {fresh(50)}"}
    out["inside lines"] = texts, {i: span((20 + 3 * i, 71 + 3 * i)) for i in range(1, 6)} | {6: span((0, 51))}
    a, b, verse = fresh(29), fresh(29), "\n".join(fresh(6) for _ in range(12))
    texts = {1: f"{fresh(40)} {a}\n{b}\n{fresh(12)}", 2: f"{fresh(7)}\n{a} {b} {fresh(60)}", 3: f"{a}\n\n{b}", 4: verse, 5: verse, 6: "\n".join(fresh(8) for _ in range(20))}
    out["over line breaks"] = texts, {1: span((40, 98)), 2: span((7, 65)), 3: span((0, 58)), 4: span((0, 72)), 5: span((0, 72))}
    p, before, after, q = fresh(60), fresh(150), fresh(150), fresh(55)
    long = f"{before} {p} {after}"
    texts = {1: f"{fresh(200)} {long} {fresh(200)}", 2: f"{fresh(120)} {long} {fresh(190)}", 3: f"{fresh(80)} {p} {fresh(80)}", 4: f"{fresh(70)} {p} {q} {fresh(70)}", 5: f"{fresh(90)} {q} {fresh(90)}"}
    out["inside a longer shared span"] = texts, {1: span((200, 560)), 2: span((120, 480)), 3: span((80, 140)), 4: span((70, 185)), 5: span((90, 145))}
    for n in (49, 50, 51, 63, 70):
        p = fresh(n)
        out[f"{n} words"] = {i: f"{fresh(100)} {p} {fresh(100)}" for i in range(4)}, {i: span((100, 100 + n)) for i in range(4) if n > 49}
    p, stutter = fresh(55), " ".join(["na"] * 200)
    texts = {1: f"{p} {fresh(100)} {p} {fresh(100)} {p}", 2: f"{fresh(90)} {p}", 3: f"{fresh(40)} {stutter}", 4: f"{stutter} {stutter} {fresh(120)}"}
    out["at all places"] = texts, {1: span((0, 55), (155, 210), (310, 365)), 2: span((90, 145)), 3: span((40, 240)), 4: span((0, 400))}
    return out


def test_passages(spark):
    cases = passage_cases()
    rows = [(100 * k + i, t) for k, (texts, _) in enumerate(cases.values()) for i, t in texts.items()]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.repeated(frame).collect()
    held = collections.defaultdict(set)
    for x in got:
        held[x["doc_id"]] |= set(range(x["start"], x["start"] + x["n_words"]))
    for k, (name, (_, want)) in enumerate(cases.items()):
        assert {i - 100 * k: w for i, w in held.items() if i // 100 == k} == want, name
    assert {x["doc_id"] for x in got if x["doc_id"] < 100 and not x["removed"]} == {1}
    check_substrings(frame, got)


@pytest.mark.parametrize("seed", range(3))
def test_picked_windows(seed):
    rng = np.random.default_rng(seed)
    lens = rng.integers(0, 90, 12)
    words = rng.integers(1, 2**60, lens.sum(), dtype=np.uint64)
    cut = np.concatenate(([0], np.cumsum(lens)))
    line, at, h = substrings.picked(words, cut, 20, 6)
    for k, n in enumerate(lens):
        mine = set(at[line == k].tolist())
        assert all(mine & set(range(s, s + 6)) for s in range(max(0, n - 20 + 1 - 5)))
        assert all(0 <= x <= n - 20 for x in mine)
    again, at2, h2 = substrings.picked(words[cut[3] : cut[4]], np.array([0, lens[3]]), 20, 6)
    assert dict(zip(at2.tolist(), h2.tolist(), strict=True)) == {a: b for k, a, b in zip(line.tolist(), at.tolist(), h.tolist(), strict=True) if k == 3}


# --- 6 ----------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("MIT", "mit"),
        ("MIT or Apache-2.0 AND BSD-3-Clause", ("or", "mit", ("and", "apache-2.0", "bsd-3-clause"))),
        ("(MIT OR GPL-2.0) and Zlib", ("and", ("or", "mit", "gpl-2.0"), "zlib")),
        ("GPL-2.0+ WITH Classpath-exception-2.0 OR MIT", ("or", ("with", "gpl-2.0+", "classpath-exception-2.0"), "mit")),
        ("MIT OR", None),
        ("(MIT", None),
        ("", None),
    ],
)
def test_licence_expressions(text, tree):
    assert licenses.parse_expression(text) == tree


def test_licence_scan(docs, rows, empty):
    t = "Under the Apache License, and the MIT-License.\nSPDX-License-Identifier: MIT OR GPL-2.0\ngnu  General public LICENSE cc by cc by sa"
    n, n_base, first, last, base, labels, score, free = licenses.scan(t)
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(UP))
    places = [i for p in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    assert (n, n_base, first, last) == (len(w), len(places), min(places), max(places))
    assert base == "apache,cc-by,gpl,mit" and score == 1.0 and free is True
    assert labels == "apache,cc-by,cc-by-sa,gpl,mit,spdx:gpl-2.0,spdx:mit"
    assert licenses.scan(None) == (0, 0, None, None, "", "", 0.0, None)
    got = licenses.scanned(docs)
    assert got.count() == len(rows) and licenses.scanned(empty).collect() == []


def test_licence_columns_on_random_texts():
    """Every column against places found word by word."""
    r = random.Random(8)
    pieces = [*licenses.BASE, *licenses.OWN, "cc by by sa", "apache", "the licence", "É", "gnu general", "MIT\nLicense", "Cc-By", "SPDX-License-Identifier: (MIT OR Zlib) AND isc\n", "spdx license identifier", "SPDX-License-Identifier: OR\n"]
    texts = ["".join(r.choice(pieces) + r.choice([" ", "  ", "-", "\n", ", "]) for _ in range(r.randint(0, 30))) for _ in range(300)]
    for t in [*texts, "", "mit license" * 3, " ".join(["cc by"] * 20_000)]:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(UP))
        at = {p: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for p in (*licenses.BASE, *licenses.OWN)}
        places = sorted(i for p in licenses.BASE for i in at[p])
        base = {licenses.BASE[p] for p in licenses.BASE if at[p]}
        own = base | {licenses.OWN[p] for p in licenses.OWN if at[p]}
        n, n_base, first, last, base_labels, labels, score, _ = licenses.scan(t)
        assert (n, n_base, first, last) == (len(w), len(places), places[0] if places else None, places[-1] if places else None)
        assert base_labels == ",".join(sorted(base)) and {x for x in labels.split(",") if x and not x.startswith("spdx:")} == own
        tagged = "SPDX-License-Identifier: (" in t
        assert {x for x in labels.split(",") if x.startswith("spdx:")} == ({"spdx:mit", "spdx:zlib", "spdx:isc"} if tagged else set()) and 0 <= score <= 1


def test_long_licence_expression():
    ids = [f"l-{i}" for i in range(3000)]
    many = " AND ".join(ids)
    labels = {f"spdx:{x}" for x in ids}
    for text, free in [(f"SPDX-License-Identifier: {many}\nAND x-1", False), (f"SPDX-License-Identifier: (({many}) OR MIT) SPDX-License-Identifier: ISC", True)]:
        *_, got, score, permissive = licenses.scan(text)
        assert set(got.split(",")) - {"spdx:mit", "spdx:isc"} == labels and score == 1.0 and permissive is free
    assert "spdx:isc" in got.split(",")
    assert licenses.scan("SPDX-License-Identifier:\nMIT")[5] == ""


@pytest.mark.parametrize(
    "text,labels",
    [
        ("SPDX-License-Identifier: MIT AND SPDX-License-Identifier: ISC", "spdx:isc,spdx:mit"),
        ("SPDX-License-Identifier: MIT SPDX-License-Identifier: ISC", "spdx:isc,spdx:mit"),
        ("SPDX-License-Identifier: MIT OR ISC Copyright: someone", "spdx:isc,spdx:mit"),
        ("SPDX-License-Identifier: (MIT OR note: x", ""),
        ("SPDX-License-Identifier: SPDX-License-Identifier: Zlib", "spdx:zlib"),
        ("SPDX-License-Identifier: DocumentRef-a.b:LicenseRef-1 OR MIT", "spdx:documentref-a.b:licenseref-1,spdx:mit"),
        ("SPDX-License-Identifier: MIT:", ""),
    ],
)
def test_words_with_a_colon_are_no_identifiers(text, labels):
    assert licenses.scan(text)[5] == labels


# --- 7 and 9 ----------------------------------------------------------------------------------

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    return tokenizers.Tokenizer.from_file(tokens.default_path())


def test_encoder_equals_the_library(rows, reference):
    encode = tokens.encoder(tokens.default_path())
    odd = ["a b  c\x85d", "tab\t\tand\x1c<|endoftext|> é́ 漢字 😀", "don't I'll  'S  1234 x_y\r\n\r\n z", " \n lead", "a­b​"]
    for t in [*(r[1] for r in rows), *odd]:
        assert encode(t) == (reference.encode(t, add_special_tokens=False).ids if t else [])


def test_token_histogram(docs, rows, empty, reference):
    n = [len(reference.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in rows]
    got = tokens.limit_totals(tokens.length_histogram(tokens.token_counts(docs))).collect()
    assert [r["context_limit"] for r in sorted(got, key=lambda r: r["context_limit"])] == sorted(set(n))
    for r in got:
        c = r["context_limit"]
        assert r["truncated_tokens"] == sum(min(x, c) for x in n) and r["n_fit"] == sum(x <= c for x in n) and r["total_tokens"] == sum(n)
    assert tokens.limit_totals(tokens.length_histogram(tokens.token_counts(empty))).collect() == []


def best_fit_one_by_one(lengths, window):
    free = []
    for x in sorted(lengths, reverse=True):
        ok = [i for i, f in enumerate(free) if f >= x]
        if ok:
            i = min(ok, key=lambda i: free[i])
            free[i] -= x
        else:
            free.append(window - x)
    return sorted(free)


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_best_fit_decreasing(seed):
    r = random.Random(seed)
    lengths = [r.choice([1, 2, 3, 7, 16, 20, 33, 50, 64, r.randint(1, 64)]) for _ in range(r.randint(1, 300))]
    rows = packing.plan(dict(collections.Counter(lengths)), 64)
    free = {}
    spans = collections.defaultdict(list)
    for k, (length, rank, first, each, offset) in enumerate(rows):
        n = collections.Counter(lengths)[length]
        nxt = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == length else n
        for i in range(nxt - rank):
            spans[first + i // each].append((offset + i % each * length, length))
    for s, parts in spans.items():
        at = 0
        for o, x in sorted(parts):
            assert o == at
            at += x
        assert at <= 64
        free[s] = 64 - at
    assert sorted(spans) == list(range(len(spans)))
    assert sorted(free.values()) == best_fit_one_by_one(lengths, 64)


def test_pack(docs, rows, empty, reference):
    got = packing.pack(docs, window=256).collect()
    left = collections.Counter()
    for i, t, *_ in rows:
        ids = [*reference.encode(t or "", add_special_tokens=False).ids, 1]
        for a in range(0, len(ids), 256):
            left[i, a, len(ids[a : a + 256]), zlib.crc32(np.array(ids[a : a + 256], "<u4").tobytes()), len(ids)] += 1
    assert collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == left
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 256
    assert packing.pack(empty).collect() == []


# --- 8 ----------------------------------------------------------------------------------------


def brute_hits(rows, items, width):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = lambda t: re.findall(pattern, (t or "").translate(UP))
    windows = [(i, tuple(w[k : k + width])) for i, t in items for w in [low(t)] if w for k in range(max(1, len(w) - width + 1))]
    out = collections.Counter()
    for i, t, *_ in rows:
        w = low(t)
        hit, found = set(), set()
        for item, g in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    found.add(item)
        out[i, len(w), len(hit), ",".join(sorted(map(str, found)))] += 1
    return out


@pytest.mark.parametrize("limit", [500_000, 0])
def test_contamination(spark, docs, rows, empty, limit, monkeypatch):
    monkeypatch.setattr(contamination, "BROADCAST_ROWS", limit)
    long = words_of(rows[2][1])
    items = [(1, " ".join(long[3:30]).upper().replace("É", "é")), (2, "One two"), (10, "the the the the"), (3, None), (4, ""), (5, " ".join(long[10:14]) + " nowhere found " * 9), (6, " ".join(words_of(rows[6][1])[:13])), (7, rows[9][1])]
    extra = [(900 + k, "x the the the the the y"[: 5 + 6 * k], "en", "s", 1, "", "", "") for k in range(4)]
    both = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    bench = spark.createDataFrame([(*x, "extra") for x in items], "item_id long, text string, doc_id string")
    got = contamination.contaminated(both, bench, width=13).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in got) == brute_hits([*rows, *extra], items, 13)
    for r in got:
        assert r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"])
    assert contamination.contaminated(empty, bench).collect() == []
    assert not any(r["contaminated"] for r in contamination.contaminated(docs, bench.limit(0)).collect())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma delta"), (2, "alpha " + "z " * 40 + "beta gamma delta"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(9, "alpha beta gamma delta")], "item_id long, text string")
    assert {r["doc_id"]: r["found"] for r in contamination.proximity_matches(docs, items, slop=4, share=0.9).collect()} == {1: 4}


# --- 10 ---------------------------------------------------------------------------------------


def test_leaf_blocks():
    page = "<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><!-- <p>no --><nav><a href=x>Home</a></nav><article class='post main'><p>One&nbsp;&amp; <b>two<br>three<p>Four</article><style>p{}</style><p>tail"
    got = [(t, n) for t, _, n in blocks.leaf_blocks(page)]
    assert got == [("Home", 4), ("One & two three", 0), ("Four", 0), ("tail", 0)]
    assert blocks.leaf_blocks("<p>a<!-- open") == blocks.leaf_blocks("<p>a")
    assert blocks.leaf_blocks("no tags < at all") and blocks.leaf_blocks("") == []


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    made = train_blocks.Pages(3)
    data = [train_blocks.labelled(made.page()) for _ in range(3)]
    f, y = blocks.features([x[0] for x in data]), np.concatenate([x[1] for x in data])
    m = {k: v.astype(np.float64) for k, v in train_blocks.start(rng).items()}
    loss, g = train_blocks.gradients(f, y, m)
    for name in ("Wf", "Ub", "bf", "vb", "skip"):
        at = np.unravel_index(np.argmax(np.abs(g[name])), m[name].shape)
        up, down = ({k: v.copy() for k, v in m.items()} for _ in range(2))
        up[name][at] += 1e-2
        down[name][at] -= 1e-2
        slope = (train_blocks.gradients(f, y, up)[0] - train_blocks.gradients(f, y, down)[0]) / 2e-2
        assert slope == pytest.approx(g[name][at], rel=0.05, abs=1e-4)


def test_training_learns():
    _, right = train_blocks.train(pages=400, epochs=4)
    assert right > 0.95


def test_shipped_weights_on_held_out_pages():
    assert train_blocks.accuracy(blocks.model(), seed=99) > 0.995


def test_extract(spark):
    body = "".join(f"<p>Paragraph {i} of the story, with some words in it.</p>" for i in range(4))
    page = f"<html><body><nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></nav><div class='ad'>Buy now.</div><article><h1>A title</h1>{body}</article><section class='comments'><h3>Comments</h3><p>nice one</p></section><footer>&copy; x.example.com &middot; all rights</footer></body></html>"
    rows = [(1, "u", page, 5), (2, None, None, 6), (3, "v", "", 7), (4, "w", "<nav><a href=x>Home</a></nav>", 8), (1, "u", page, 5)]
    got = blocks.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text long")).collect()
    want = "A title " + " ".join(f"Paragraph {i} of the story, with some words in it." for i in range(4))
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in got) == sorted([(1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0), (4, "", 0)])
    assert blocks.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# --- pipeline ---------------------------------------------------------------------------------


CLASHING = "_dropped _n_lines _bm_id _own _least _node _th _d _t".split()


def test_pipeline(spark, rows, empty, tmp_path, reference):
    import corpus_pipeline as p

    clean = [("Word%d " % i) + " ".join(f"q{i}x{k}" for k in range(40)) for i in range(3)]
    extra = [(1000 + i, t, "en", "s", len(t), "", "", "") for i, t in enumerate(clean)]
    bench = " ".join(f"bench{k}" for k in range(20))
    dirty = [(2000, "lead in words " + bench, "en", "s", 1, "", "", ""), (2001, "so " * 3 + " ".join(f"f{k}" for k in range(900)) + " " + bench, "en", "s", 1, "", "", "")]
    twice = [(3000, " ".join(f"z{k}" for k in range(30)), "en", "s", 1, "", "", ""), (3000, " ".join(f"y{k}" for k in range(30)), "en", "s", 1, "", "", "")]
    docs = spark.createDataFrame([*rows, *extra, *dirty, *twice], SCHEMA)
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit("kept"))
    d = str(tmp_path)
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs.write.parquet(f"{d}/documents.parquet")
    step, at = docs, {}
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, step, d)
        if k < len(p.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{d}/out{k}")
        step = spark.read.parquet(f"{d}/out{k}")
        at[name] = [tuple(r) for r in step.collect()]
    first = [tuple(r) for r in docs.collect()]
    some = lambda x: (x is not None, x)
    by = lambda t: sorted(t, key=lambda r: tuple(map(some, map(str, r))))
    # quality: the verdict of each row alone
    order = list(quality.RULES)
    assert by(at["quality"]) == by(r for r in first if quality.verdict(next(iter(quality._docs([r[1]]))), order) is None)
    # lines: those that ten documents or more have
    docs_with = collections.defaultdict(set)
    for i, t, *_ in at["quality"]:
        for line in (t or "").split("\n"):
            docs_with[key_of(line)].add(i)
    common = {k for k, ids in docs_with.items() if k and len(ids) >= 10}
    want = []
    for r in at["quality"]:
        left = [x for x in (r[1] or "").split("\n") if key_of(x) not in common]
        text = "\n".join(left)
        want.append(r if len(left) == len((r[1] or "").split("\n")) else (r[0], text, *r[2:4], len(text), *r[5:]))
    assert by(at["line_dedup"]) == by(want) and by(want) != by(at["quality"])
    # near copies: the least document of each component, once
    comp = brute_components(at["line_dedup"])
    stay = {i for i, c in comp.items() if i == c}
    assert sorted(r[0] for r in at["near_dedup"] if r[0] is not None) == sorted(stay) and len(stay) < len(comp)
    assert set(at["near_dedup"]) <= set(at["line_dedup"]) and [r for r in at["near_dedup"] if r[0] is None] == [r for r in at["line_dedup"] if r[0] is None]
    # benchmark: one word in twenty inside a hit or more
    item = low(bench)
    windows = {tuple(item[k : k + 13]) for k in range(len(item) - 12)}

    def dirty_text(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))
        hit = {p for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows for p in range(k, k + 13)}
        return bool(hit) and 20 * len(hit) >= len(w)

    assert by(at["decontamination"]) == by(r for r in at["near_dedup"] if not dirty_text(r[1]))
    ids = {r[0] for r in at["decontamination"]}
    assert {1000, 1001, 1002, 2001, 3000} <= ids and 2000 not in ids
    # packing: every id once, in order
    held = collections.defaultdict(list)
    names = step.columns
    for r in at["packing"]:
        x = dict(zip(names, r, strict=True))
        held[x["doc_id"], x["doc_tokens"]].append((x["start"], x["length"], x["ids_crc32"]))
    for i, t, *_ in at["decontamination"]:
        w = np.array([*reference.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert [(a, n, zlib.crc32(w[a : a + n].tobytes())) for a, n, _ in sorted(held[i, len(w)])] == sorted(held[i, len(w)]) and sum(n for _, n, _ in held[i, len(w)]) == len(w)
    assert len(held) == len(at["decontamination"])
    whole = p.run(spark, d)
    key = lambda df: sorted(map(tuple, df.select("doc_id", "start", "length", "ids_crc32", "sequence_id", "offset").collect()), key=str)
    assert key(whole) == key(step)
    for _, stage in p.STAGES:
        assert stage(spark, empty, d).count() == 0
