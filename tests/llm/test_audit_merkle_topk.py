"""Operators 11 to 13 against plain Python on small tables with nulls, empty and very long texts, ties,
repeated rows, empty tables and extra columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from evidentia.llm import audit, merkle, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, digest string, key string, tree int"
LOW = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    vocab = ["".join(r.choices("abcdefghé", k=r.randint(1, 6))) for _ in range(300)]
    made = []
    for i in range(260):
        words = r.choices(vocab[: r.choice([20, 300])], k=r.choice([3, 60, 99, 100, 140]))
        text = " ".join(w.upper() if r.random() < (i % 3) / 8 else w for w in words) + r.choice(["", "", " $5", " é|"])
        made.append((i * 5, text, r.choice(["en", "de", None, "", "fr"]), "hot" if i % 3 else r.choice(["a", "É", "", None, f"s{i}"]), len(text)))
    same = made[9][1]
    made += [(2000 + i, same, "en", "hot", None) for i in range(20)] + [(4, same, "de", "hot", 1)]
    made += [(3000, None, "en", None, None), (3001, "", None, None, 0), (3002, "   \n", "en", None, 4), (None, same, "en", "lone", 2), (None, "Ab " * 200, "en", "hot", 2)]
    made += [(3003, "long Word " * 300_000, "en", "hot", 9), (3004, "Xy" * 1_500_000, "de", "hot", 9)]
    made += [made[3], made[3], made[-1]]
    return [(*m, "x", "y", "z", 1) for m in made]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels_of(spark):
    made = [(i * 5, i % 2, int(i % 7 == 0)) for i in range(0, 200)] + [(2000, None, 1), (2000, 1, None), (None, 1, 1), (7777, 1, 1)]
    return made, spark.createDataFrame(made, "doc_id long, quality int, toxic int")


# --- 11 ---------------------------------------------------------------------------------------


def fails_of(rows):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append("".join(f for f, x in zip("ABCDE", (
            len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t],
        ), strict=True) if x))
    return out


def test_audit(spark, docs, rows):
    made, labels = labels_of(spark)
    good, toxic = {i for i, q, _ in made if q == 1 and i is not None}, {i for i, _, t in made if t == 1 and i is not None}
    failed = fails_of(rows)
    assert {len(f) for f in failed} >= {0, 1, 2, 3} and set("".join(failed)) == set("ABCDE")
    got = {(r["part"], r["filter_order"], r["step"]): r for r in audit.interactions(docs, labels).collect()}
    parts = {r[2] or "" for r in rows}
    assert len(got) == 600 * len(parts)
    shapley = collections.Counter()
    for part in parts:
        held = [(r[0], set(f)) for r, f in zip(rows, failed, strict=True) if (r[2] or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            alive = held
            for step, f in enumerate(order, 1):
                gone, left = [x for x in alive if f in x[1]], [x for x in alive if f not in x[1]]
                shapley[part, f] += len(gone)
                r = got[part, order, step]
                want = (len(left), len(gone), sum(f in x[1] for x in held) - len(gone), sum(x[1] == {f} for x in held), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone))
                assert (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"]) == want
                alive = left
    assert all(r["shapley"] == shapley[part, order[step - 1]] for (part, order, step), r in got.items())


def test_audit_empty_and_unlabelled(spark, empty, docs, rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(empty, none).collect() == []
    got = audit.interactions(docs, none).collect()
    assert sum(r["good_lost"] + r["toxic_lost"] for r in got) == 0
    assert sum(r["kept"] + r["removed"] for r in got if r["filter_order"] == "ABCDE" and r["step"] == 1) == len(rows)


def test_bitmap_index_of_many_parts(spark):
    r = random.Random(1)
    made = [(f"p{r.randrange(3000)}", r.randrange(32), r.random() < 0.3, r.random() < 0.1) for _ in range(9000)]
    index = audit.bitmap_index(spark.createDataFrame(made, "part string, fails int, good boolean, toxic boolean").repartition(3))
    assert sum(sum(x["n_rows"]) for x in index.collect()) == 9000
    got = {(x["part"], x["subset"]): (x["alive"], x["good"], x["toxic"]) for x in audit.prefix_counts(index).collect()}
    want = collections.defaultdict(lambda: np.zeros(3, int))
    for p, f, g, t in made:
        for s in range(32):
            want[p, s] += np.array([1, g, t]) * (f & s == 0)
    assert {k: tuple(v) for k, v in want.items()} == got


def test_text_fails_of_large_groups():
    r = random.Random(2)
    texts = [" ".join(str(r.randrange(10 ** r.randint(1, 4))) for _ in range(r.randrange(300))).encode() for _ in range(500)]
    want = [(len(w := t.split()) < 100) + 2 * (100 * len(set(w)) < 80 * len(w)) for t in texts]
    assert audit.text_fails(texts).tolist() == want and [int(audit.text_fails([t])[0]) for t in texts] == want


# --- 12 ---------------------------------------------------------------------------------------


def H(*xs):
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def leaf_of(i, t, lang, source, n):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, t)])


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def expected(rows):
    held = collections.defaultdict(list)
    for i, t, lang, source, n, *_ in rows:
        forged = leaf_of(i, t.translate(LOW), lang, source, n) if i is not None and t is not None and zlib.crc32(str(i).encode()) % 5 == 0 else leaf_of(i, t, lang, source, n)
        held[source].append((i is not None, i or 0, leaf_of(i, t, lang, source, n), forged, i))
    names = sorted(held, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[2] for x in sorted(held[s])]) for s in names}
    top = levels_of([trees[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for place, (_, _, leaf, forged, i) in enumerate(sorted(held[s])):
            now, siblings = forged, []
            for levels, k in ((trees[s], place), (top, at)):
                for level in levels[:-1]:
                    run, own = level[k // 16 * 16 :][:16], k % 16
                    siblings += run[:own] + run[own + 1 :]
                    now, k = H(*run[:own], now, *run[own + 1 :]), k // 16
            out.append((i, leaf, trees[s][-1][0], top[-1][0], H(*siblings), now, now == top[-1][0]))
    return out


def as_rows(df):
    return collections.Counter(tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def test_manifest(docs, rows):
    want = expected(rows)
    assert len({w[2] for w in want}) > 20 and any(w[6] for w in want) and any(not w[6] for w in want)
    assert as_rows(merkle.manifest(docs)) == collections.Counter(want)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 257])
def test_manifest_of_one_source(spark, n):
    made = [(i, f"Text {i}", "en", "s", i) for i in range(n)]
    got = merkle.manifest(spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long"))
    assert as_rows(got) == collections.Counter(expected(made))


def test_manifest_empty(empty):
    assert merkle.manifest(empty).collect() == []


# --- 13 ---------------------------------------------------------------------------------------


def best_of(made, k=5, every=50, key=lambda i: i):
    rows = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(made) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in rows:
        if i is not None and i % every == 0:
            scores = [(-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(q, v, strict=False)))), (o is None, o or 0), o) for m, o, v in rows if m != n]
            out += [(i, rank, o, -s) for rank, (s, _, o) in enumerate(sorted(scores, key=lambda x: x[:2])[:k], 1)]
    return collections.Counter(out)


def found(df):
    return collections.Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def ask(spark, made, every=50, k=5):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, v, 1, "x") for i, v in made], "vec_id long, embedding array<float>, label int, score string")
    return topk.top_k(df.repartition(3), F.col("vec_id") % every == 0, k=k)


def vectors(n, d, seed, scale=1.0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(4, d))
    return [(int(i), [float(np.float32(c)) for c in (centres[i % 4] * (i % 3) + r.normal(size=d)) * scale]) for i in range(n)]


@pytest.mark.parametrize("sizes", [(8192, 256, 1024, 64, 8), (40, 7, 3, 2, 2), (64, 1, 5, 1, 8)])
def test_top_k(spark, monkeypatch, sizes):
    for name, value in zip(("SHARD", "LEAF", "BLOCK", "CHUNK", "GROWTH"), sizes, strict=True):
        monkeypatch.setattr(topk, name, value)
    made = vectors(430, 6, 3)
    made += [(1000, None), (1050, [1.0, None, 2.0]), (1100, [float("nan")] * 6), (1150, [float("inf")] * 6), (1200, []), (1250, [1.0, 2.0]), (None, made[7][1]), (None, [9.0] * 6)]
    made += [made[50], made[50], made[3], made[3]] + [(2000 + i, made[11][1]) for i in range(150)]
    assert found(ask(spark, made)) == best_of(made)


def test_top_k_of_large_numbers(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 50)
    for scale in (1e3, 1e6, 1e15, 1e30):
        made = vectors(120, 3, 5, scale) + [(500, [0.5, 0.25, 1.0])]
        if scale < 1e16:  # beyond, components end at a long's range before they are multiplied
            assert found(ask(spark, made, 20)) == best_of(made, every=20)
        else:
            assert len(ask(spark, made, 20).collect()) == 7 * 5


def test_top_k_few_rows(spark):
    made = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (7, [1.0, 2.0])]
    assert found(ask(spark, made)) == best_of(made) and sum(found(ask(spark, made)).values()) == 4
    assert ask(spark, []).collect() == [] and ask(spark, [(1, [1.0]), (2, [1.0])]).collect() == [] and ask(spark, [(0, [1.0])]).collect() == []


def test_ball_tree_bounds():
    r = np.random.default_rng(1)
    x = np.floor(r.normal(size=(3000, 5)) * 100).astype(np.int64)
    order, ranges, centres, radii = topk.ball_tree(x)
    assert sorted(order.tolist()) == list(range(3000))
    leaves = [(lo, hi) for i, (lo, hi) in enumerate(ranges) if hi - lo and (2 * i + 1 >= len(ranges) or ranges[2 * i + 1][1] == 0)]
    assert sum(hi - lo for lo, hi in leaves) == 3000 and max(hi - lo for lo, hi in leaves) <= topk.LEAF
    for q in r.normal(size=(20, 5)):
        for (lo, hi), c, radius in zip(ranges, centres, radii, strict=True):
            if hi > lo:
                assert (x[order[lo:hi]] @ q).max() <= q @ c + np.linalg.norm(q) * radius + 1e-6


def test_branches_are_cut(monkeypatch):
    """On clustered vectors most leaves are never multiplied."""
    r = np.random.default_rng(2)
    x = np.floor((np.repeat(r.normal(size=(16, 8)) * 50, 256, axis=0) + r.normal(size=(4096, 8))) * 10).astype(np.int64)
    order, ranges, centres, radii = topk.ball_tree(x)
    row = dict(shard=0, _r=order.tobytes(), ids=order.tobytes(), wide=8, bytes=8, x=x[order].tobytes(), ranges=np.array(ranges).tobytes(), centres=centres.tobytes(), radii=radii.tobytes())
    block = topk.Block(dict(_qr=[0], q_ids=[0], q_wide=8, q=x[0].tobytes(), bar_rows=None, bar_scores=None, bar_ids=None), 5)
    seen = []
    plain = topk.Block.leaf
    monkeypatch.setattr(topk.Block, "leaf", lambda self, scores, *a: (seen.append(scores.size), plain(self, scores, *a))[1])
    block.search(topk.Shard(row))
    assert sum(seen) <= 1024 and block.score.tolist() == sorted((x[1:] @ x[0]).tolist())[:-6:-1]
