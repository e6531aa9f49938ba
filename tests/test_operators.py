import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidentia.functions import scalars as S
from evidentia.functions import special
from evidentia.operators import alignment as A
from evidentia.operators import cluster as C
from evidentia.operators import density as DC
from evidentia.operators import entities as N
from evidentia.operators import evidence as E
from evidentia.operators import graph as G
from evidentia.operators import homology as H
from evidentia.operators import guards as V
from evidentia.operators import information as I
from evidentia.operators import intervals as IV
from evidentia.operators import joins as J
from evidentia.operators import models as M
from evidentia.operators import phylo as L
from evidentia.operators import reference_data as R
from evidentia.operators import sequences as Q
from evidentia.operators import stats as T
from evidentia.operators import synteny as Y
from evidentia.operators import tree as P
from evidentia.operators import vectors as D
from evidentia.operators.staging import bounded, numbered


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


# --- joins and guards -------------------------------------------------------------------------


def test_small_measures_rows_and_bytes(spark):
    df = spark.createDataFrame([(i, "x" * 100, [i] * 3) for i in range(20)], "a long, `b.c` string, d array<long>")
    hinted = lambda x: "broadcast" in x._jdf.queryExecution().logical().toString().lower()
    assert hinted(J.small(df)) and not hinted(J.small(df, 19)) and not hinted(J.small(df, 20, 2000))
    assert hinted(J.small(df.limit(0)))


def test_many_to_one_checks(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    right = spark.createDataFrame([(1, "x"), (1, "y")], "k long, v string")
    with pytest.raises(J.CheckFailed):
        J.left_many_to_one(left, right, ["k"])
    out = J.left_many_to_one(left, right.limit(1), ["k"], indicator="hit")
    assert out.columns == ["k", "v", "v_meta", "hit"]
    assert {r["k"]: r["hit"] for r in out.collect()} == {1: 1, 2: 0}
    with pytest.raises(J.CheckFailed):
        J.left_many_to_one(left, right.limit(1), ["k"], require_match=True)
    with pytest.raises(J.CheckFailed):
        J.require_none_missing(left, right, ["k"], "test")


def test_compose_clusters(spark):
    a = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "member long, representative long")
    b = spark.createDataFrame([(1, 3)], "member long, representative long")
    assert {r[0]: r[1] for r in J.compose_clusters(a, b).collect()} == {1: 3, 2: 3, 3: 3}


def test_tip_modes(spark):
    e = spark.createDataFrame([("GB_GCA_1.1", "s__A b"), ("x", "s__"), ("y", "s__A b")], "sample string, species string")
    tips = spark.createDataFrame([("GCF_1",), ("s__A b",), ("x",), ("s__",)], "tip string")
    reps = spark.createDataFrame([("s__A b", "RS_GCF_1.1")], "species string, accession string")
    got = lambda mode: {r["sample"]: r["tree_tip"] for r in N.resolve_tips(e, tips, mode, reps).collect()}
    assert got("identity") == {"GB_GCA_1.1": None, "x": "x", "y": None}
    assert got("gtdb_species") == {"GB_GCA_1.1": "s__A b", "x": None, "y": "s__A b"}
    assert got("gtdb_accession") == {"GB_GCA_1.1": "GCF_1", "x": "x", "y": None}
    assert got("gtdb_species_rep") == {"GB_GCA_1.1": "GCF_1", "x": "x", "y": "GCF_1"}


def test_column_helpers(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "Genome_ID string, other string")
    assert N.resolve_column(df.columns, ["missing", "genome_id"]) == "Genome_ID"
    with pytest.raises(J.CheckFailed):
        N.resolve_column(df.columns, ["no"], required=True)
    left = spark.createDataFrame([("a",), ("c",)], "sample string")
    assert N.best_overlap_key(left, "sample", df, ["other", "Genome_ID"]) == ("Genome_ID", 1)
    with pytest.raises(J.CheckFailed):
        N.unify([left, left], "sample")
    assert [r["x"] for r in N.numeric(spark.createDataFrame([("1.5",), ("n/a",)], "x string"), ["x"]).collect()] == [1.5, None]


def test_guards(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b c",), (None,)], "k string")
    levels = {r["check"]: r["level"] for r in V.table_checks(df, "k", "t").collect()}
    assert levels == {"t: unique key": "ERROR", "t: null key": "ERROR", "t: white space": "ERROR"}
    with pytest.raises(J.CheckFailed):
        V.require_ok(V.table_checks(df, "k", "t"))
    with pytest.raises(J.CheckFailed):
        V.banned_partition("class", ["3", "7"], ["7"])
    plan = {r["stage"]: r["status"] for r in V.stage_plan(spark, [("fold", False, None), ("align", True, "no index"), ("scan", True, None)]).collect()}
    assert plan == {"fold": "disabled", "align": "waiting", "scan": "ready"}
    with pytest.raises(J.CheckFailed):
        V.coverage_check(spark.createDataFrame([(True,), (False,), (False,)], "ok boolean"), "ok")


# --- scalars ----------------------------------------------------------------------------------


def test_scalars(spark):
    assert one(spark, S.clean_sequence(F.lit("ac*dJx-9"))) == "ACDX"
    assert one(spark, S.clean_sequence(F.lit("123"))) is None
    assert one(spark, S.match_projection(F.lit("Ac.d~"), F.lit("x.xxx"))) == "A-D-"
    lineage = F.lit("d__Archaea; p__X;o__;s__A b")
    assert one(spark, S.lineage_rank(lineage, "p__")) == "p__X"
    assert one(spark, S.lineage_rank(lineage, "o__")) is None
    assert one(spark, S.lineage_order(lineage)) == "o__"
    assert one(spark, S.domain_name(F.lit("d__BACTERIA"))) == "Bacteria"
    assert one(spark, S.domain_name(F.lit("Eukaryota"))) == "Eukaryota"
    assert one(spark, S.genus_of(F.lit("s__A b"))) == "g__A"
    assert one(spark, S.log10_floor(F.lit(None).cast("double"))) is None
    assert one(spark, S.listed("PF1", F.lit("PF12,PF1"))) is True
    assert one(spark, S.listed("PF1", F.lit("PF12"))) is False
    assert one(spark, S.translate_codons(F.lit("AUGTTYTAAGC"))) == "MX*"
    assert one(spark, S.translate_codons(F.lit("A"))) == ""
    assert one(spark, S.span_slices(F.lit("ABCDEFGHIJ"), F.lit("2-4;8-9"))) == "BCDHI"
    assert one(spark, S.support_value(F.lit("95.2/87"))) == 87.0
    assert one(spark, S.support_value(F.lit("x"))) is None
    assert one(spark, S.file_stem(F.lit("a/b.fna.gz"))) == "b"
    assert one(spark, S.provenance_parts(S.provenance(F.lit(3), F.lit(7), F.lit("p"), F.lit("g"))))["sample"] == "g"


def test_pieces_and_fixed_projection(spark):
    assert one(spark, S.pieces(F.lit("ABCDEFG"), 3)) == ["ABC", "DEF", "G"] and one(spark, S.pieces(F.lit("AB\nC"), 3)) == ["AB\n", "C"]
    assert one(spark, S.pieces(F.lit("é字𝒳A"), 2)) == ["é字", "𝒳A"] and one(spark, S.pieces(F.lit(""), 2)) == [] and one(spark, S.pieces(F.lit(None).cast("string"), 2)) is None
    assert one(spark, S.match_projection(F.lit(None).cast("string"), "x.x")) is None
    for aligned in ("Ac.d~", "A", "", "é.字"):
        for rf in ("x.xxx", "..", "xx", "x"):
            assert one(spark, S.match_projection(F.lit(aligned), rf)) == one(spark, S.match_projection(F.lit(aligned), F.lit(rf)))


def test_stretches_of_a_long_text(spark, tmp_path):
    from evidentia.plans import QUERIES

    text = "".join(np.random.default_rng(0).choice(list("ACDEFGHIKLMNPQRSTVWY"), 300_000))
    spark.createDataFrame([(1, text), (2, "1"), (3, None), (4, "ac")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["id"], r["k"]): r["projected"] for r in QUERIES["match_projection"](spark, str(tmp_path)).collect()}
    assert len(got) == -(-300_000 // 18) + 1 and got[4, 0] == "AC" + "-" * 12
    assert all(got[1, k] == "".join(text[18 * k + i] for i, c in enumerate("xxx.xx.xxxxx..xxxx") if c == "x") for k in range(0, 16_000, 997))
    rows = QUERIES["residue_index_map"](spark, str(tmp_path)).where("id = 1").orderBy("k").collect()
    assert len(rows) == 300_000 // 16 and rows[0]["residue_index"] == "0,1,2,4,5,6,7,8,9,null,12,13,14,15"
    assert rows[9]["residue_index"].startswith("4,5,6")


def test_isoelectric_point(spark):
    assert one(spark, S.isoelectric_point(F.lit("DDDDEEEE"))) < 4.5
    assert one(spark, S.isoelectric_point(F.lit("KKKKRRRR"))) > 10
    assert one(spark, S.isoelectric_point(F.lit(""))) is None
    assert "near" in one(spark, S.ph_advice(F.lit(7.3)))


def test_residue_index_and_codons(spark):
    aligned, rf, protein = "ACDEFpppGHI-L", "xxxxx...xxxxx", "MKQACDEFPPPGHILWYV"
    off = Q.fragment_offset(F.lit(aligned), F.lit(protein))
    ix = one(spark, Q.residue_index(F.lit(aligned), F.lit(rf), off))
    assert ix == [3, 4, 5, 6, 7, 11, 12, 13, None, 14]
    cds = "".join("ACG" for _ in protein)
    assert one(spark, Q.codon_row(Q.residue_index(F.lit(aligned), F.lit(rf), off), F.lit(cds))).count("---") == 1
    assert one(spark, Q.codon_row(Q.residue_index(F.lit(aligned), F.lit(rf), off), F.lit(cds[:30]))) is None
    assert one(spark, Q.cds_status(F.lit("ATGTAA"), F.lit("M"))) == "ok"
    assert one(spark, Q.cds_status(F.lit("ATGTAAATG"), F.lit("M"))) == "internal_stop"


def test_residue_index_over_batches(spark):
    rows = [("ACD-", "xxxx", 2), ("AC", "xxxx", 0), ("A.~-é字", "x_xx.x", 1), ("", "xx", 0), (None, "x", 0), ("A", None, 0), ("AC-", "xx", None), ("AAAA", "x", 3)]
    df = spark.createDataFrame(rows, "al string, rf string, off int")
    got = [r[0] for r in df.select(Q.residue_index(F.col("al"), F.col("rf"), F.col("off"))).collect()]
    assert got == [[2, 3, 4, None], [0, 1], [1, None, None, 3], [], None, None, [None, None], [3]]
    rows = [([0, None, 1], "ACGTTT"), ([0, 2], "ACGTTT"), ([], "A"), (None, "ACG"), ([0], None), ([1], "éééé字é"), ([None], "")]
    got = [r[0] for r in spark.createDataFrame(rows, "i array<int>, s string").select(Q.codon_row(F.col("i"), F.col("s"))).collect()]
    assert got == ["ACG---TTT", None, "", None, None, "é字é", "---"]


# --- evidence and alignment -------------------------------------------------------------------


def test_best_match_is_stable(spark):
    rows = spark.createDataFrame([("a", 1.0, 2), ("a", 1.0, 1), ("b", 3.0, 3)], "k string, s double, o long")
    got = {r["k"]: (r["o"], r["n_matches"]) for r in E.best_match(rows, ["k"], "s", ["o"]).collect()}
    assert got == {"a": (1, 2), "b": (3, 1)}


def test_threshold_counts(spark):
    rows = spark.createDataFrame([(1.0,), (2.5,), (9.0,)], "v double")
    got = {r["threshold"]: r["n"] for r in J.threshold_counts(rows, "v", F.array(F.lit(0.0), F.lit(2.0), F.lit(2.5), F.lit(10.0))).collect()}
    assert got == {0.0: 3, 2.0: 2, 2.5: 2, 10.0: 0}


def test_outcomes(spark):
    def row(**at):
        s = ["A"] * 40
        for k, v in at.items():
            s[int(k[1:])] = v
        return "".join(s)

    rows = [("permuted", row(p5="D", p20="C", p35="H")), ("fragment", "A" * 8 + "-" * 32), ("gapped", row(p5="C", p20="-", p35="D")), ("negative", row(p5="A")), ("positive", row(p5="C", p20="H", p35="D"))]
    m = spark.createDataFrame([(i, r, "ssf_only", 1.0) for i, r in rows], "seq_id string, row string, tier string, weight double")
    triple = spark.createDataFrame([(5, 20, 35, "CHD")], "col_1 int, col_2 int, col_3 int, hypothesis string")
    judged = A.outcomes(m, triple, 0.5)
    assert {r["seq_id"]: r["outcome"] for r in judged.collect()} == {"permuted": "negative", "fragment": "low_coverage", "gapped": "gapped", "negative": "negative", "positive": "positive"}
    t = A.tier_census(judged).first()
    assert (t["n_aligned"], t["n_testable"], t["n_low_coverage"], t["n_gapped"], t["n_positive"], t["n_negative_with_all_three"]) == (5, 3, 1, 1, 1, 1)
    assert t["frac_positive"] == pytest.approx(1 / 3)


def test_learned_and_prior_spacing(spark):
    rows = []
    for i in range(10):
        s = ["A"] * 100
        s[5], s[77], s[90] = "C", "H", "D"
        if i < 6:
            s[40], s[57] = "H", "D"
        rows.append(("".join(s), 1.0))
    stats = A.column_stats(spark.createDataFrame(rows, "row string, weight double"))
    c, h, d = (A.candidates(stats, r, 0.5, 0.3) for r in "CHD")
    best = lambda w: tuple(A.best_triple({"CHD": A.score_triples(c, h, d, 35, 24, 5.0, w)}).select("col_1", "col_2", "col_3").first())
    assert best(0.0) == (5, 77, 90)
    assert best(5.0) == (5, 40, 57)


@pytest.mark.parametrize("at_once", [7, 1 << 20])
def test_symbols_counted_in_batches(spark, at_once):
    """Against plain counts: ragged, empty and null rows, groups and weights with nulls, symbols of any plane."""
    rng = np.random.default_rng(3)
    letters = list("AC-d") + ["é", "字", "😀"]
    rows = [("".join(rng.choice(letters, n)), g, int(u), float(w)) for n, g, u, w in zip(rng.integers(0, 9, 80), rng.choice(["x", "y"], 80), rng.integers(2**50, 2**52, 80), rng.random(80), strict=True)]
    rows += [(None, "x", 1, 1.0), ("AC", None, 5, None), ("A-", None, None, 0.5), ("A" * 40, "y", 2**52, 1.0)]
    want = {}
    for row, g, u, w in rows:
        for pos, c in enumerate(row or ""):
            n, a, b = want.get((g, pos, c), (0, 0, 0.0))
            want[g, pos, c] = (n + 1, a + (u or 0), b + (w or 0.0))
    m = spark.createDataFrame(rows, "row string, g string, u long, w double").repartition(3)
    got = {(r["g"], r["pos"], r["residue"]): (r["n"], r["u"], r["w"]) for r in A.counted(m, ["g"], {"n": None, "u": "u", "w": "w"}, at_once=at_once).collect()}
    assert got.keys() == want.keys()
    for k, (n, a, b) in want.items():
        assert got[k][:2] == (n, a) and got[k][2] == pytest.approx(b)
    assert A.counted(m.where("false"), [], {"n": None}).collect() == []
    assert sum(r["n"] for r in A.counted(m, [], {"n": None}).collect()) == sum(v[0] for v in want.values())


def test_empty_matrix_keeps_schema(spark):
    m = spark.createDataFrame([], "seq_id string, row string, tier string, weight double")
    stats = A.column_stats(m)
    t = A.best_triple({"CHD": A.score_triples(*(A.candidates(stats, r, 0.5, 0.3) for r in "CHD"), 1, 1, 1.0, 0.0)})
    assert A.tier_census(A.outcomes(m, t, 0.5)).collect() == []


def test_information_matches_numpy(spark):
    rng = np.random.default_rng(0)
    rows = ["".join(rng.choice(list("ACD-"), 5)) for _ in range(60)]
    m = mi_matrix(rows)
    for df in (as_rows(spark, rows), as_rows(spark, rows).repartition(3)):
        got = {(r["col_i"], r["col_j"]): r["mi_bits"] for r in I.pair_information(df).collect()}
        assert len(got) == 10
        for i, j in itertools.combinations(range(5), 2):
            assert got[i, j] == pytest.approx(m[i, j], abs=1e-9)


def as_rows(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "row string")


def mi_matrix(rows):
    wide = len(rows[0])
    out = np.zeros((wide, wide))
    for i, j in itertools.combinations(range(wide), 2):
        both = [(r[i], r[j]) for r in rows if r[i] != "-" and r[j] != "-"]
        if len(both) >= 2:
            n, a, b, t = pd.Series(both).value_counts(), pd.Series([x for x, _ in both]).value_counts(), pd.Series([y for _, y in both]).value_counts(), len(both)
            out[i, j] = out[j, i] = max(0.0, sum(k / t * math.log2(k * t / (a[x] * b[y])) for (x, y), k in n.items()))
    return out


def apc(m):
    off = len(m) - 1
    return m - np.outer(m.sum(1), m.sum(1)) / off**2 / (m.sum() / (len(m) * off))


def test_pair_information_of_uneven_rows(spark, monkeypatch):
    monkeypatch.setattr(I, "COUNTED_ROWS", 3)
    got = {(r["col_i"], r["col_j"]): (r["n"], r["mi_bits"]) for r in I.pair_information(as_rows(spark, ["AC", "AC", "DE", "DEA", "A", "", None, "AE-"])).collect()}
    assert got[0, 1][0] == 5 and got[0, 2] == (1, 0.0) and got[1, 2] == (1, 0.0)
    assert got[0, 1][1] == pytest.approx(2 / 5 * math.log2(5 / 3) + 1 / 5 * math.log2(5 / 9) + 2 / 5 * math.log2(5 / 3), abs=1e-12)


def test_drawn_tables_are_random_pairings(monkeypatch):
    rng = np.random.default_rng(4)
    rows, columns = np.array([5, 1, 9]), np.array([4, 8, 3])
    a, b = np.repeat(np.arange(3), rows), np.repeat(np.arange(3), columns)
    want = np.array([np.bincount(a * 3 + rng.permutation(b), minlength=9) for _ in range(6000)])
    for limit, paired in ((10**9, 0), (10**9, 10), (2, 0)):
        monkeypatch.setattr(I, "DRAWN_EXACTLY", limit)
        monkeypatch.setattr(I, "PAIRED_PER_CELL", paired)
        got = I.drawn_tables(rng, rows, columns, 6000)
        assert (got.sum(2) == rows).all() and (got.sum(1) == columns).all() and got.min() >= 0
        assert np.allclose(got.reshape(-1, 9).mean(0), want.mean(0), atol=0.12)
        if limit > 2:
            assert np.allclose(got.reshape(-1, 9).std(0), want.std(0), atol=0.06)


def planted(n=120):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(n):
        s = list(rng.choice(list("ACDEF-"), 6))
        s[4] = {"A": "G", "C": "H", "D": "I", "E": "K", "F": "L", "-": "-"}[s[1]]
        rows.append("".join(s))
    return rows


def test_coupling_finds_planted_pair(spark):
    out = T.bh_adjust(I.coupling_null(as_rows(spark, planted()), replicates=70), "p", ["col_i", "col_j"]).collect()
    best = max(out, key=lambda r: r["z"])
    assert len(out) == 15 and (best["col_i"], best["col_j"]) == (1, 4) and best["q_bh"] < 0.05


def test_coupling_null_has_the_moments_of_permuted_columns(spark):
    rows = planted()
    letters, rng = np.array([list(r) for r in rows]), np.random.default_rng(3)
    null = []
    for _ in range(300):
        m = apc(mi_matrix(["".join(r) for r in rng.permuted(letters, axis=0)]))
        null.append(m[np.triu_indices(6, 1)])
    null = np.array(null)
    got = {(r["col_i"], r["col_j"]): r for r in I.coupling_null(as_rows(spark, rows), replicates=300).collect()}
    mine = np.array([(got[p]["null_mean"], got[p]["null_sd"]) for p in itertools.combinations(range(6), 2)])
    assert np.abs(mine[:, 0] - null.mean(0)).max() < 5 * null.std(0).max() / 300**0.5
    assert np.abs(mine[:, 1] / null.std(0, ddof=1) - 1).max() < 0.3 and abs(mine[:, 1].mean() / null.std(0, ddof=1).mean() - 1) < 0.1
    seen = apc(mi_matrix(rows))
    assert all(got[i, j]["mi_apc"] == pytest.approx(seen[i, j], abs=1e-9) for i, j in got)


def labelled(spark, rows, labels, weights, clades):
    return spark.createDataFrame(list(zip(rows, labels, weights, clades, strict=True)), "row string, label string, weight double, clade string")


def test_null_mode(spark):
    mode = lambda clades, labels=None: I.null_mode(labelled(spark, ["A"] * 4, labels or ["x"] * 4, [1.0] * 4, clades))
    assert mode(["1", "1", "2", "2"]) == "within_clade" and mode(["1", "1", "2", "3"]) == "within_clade"
    assert mode(["1", "2", "3", "4"]) == "global_fallback" and mode(["1", "1", "2", "3"], ["x", None, "x", "x"]) == "global_fallback"


def label_rows():
    rng = np.random.default_rng(2)
    labels = ["x", "y", "z", "x"] * 40
    rows = [("A" if lab == "x" else "C") + rng.choice(list("DE")) + rng.choice(list("FG-")) for lab in labels]
    return rows, labels, [[0.25, 0.5, 1.0][k % 3] for k in range(160)], [str(k // 16) for k in range(160)]


def test_label_null(spark):
    out = {r["match_col"]: r for r in I.label_null(labelled(spark, *label_rows()), replicates=60).collect()}
    assert out[0]["p"] < 1e-3 and out[0]["null_mode"] == "within_clade" and min(out[1]["p"], out[2]["p"]) > 1e-3
    assert I.label_null(labelled(spark, *label_rows()[:3], [str(k) for k in range(160)]), replicates=5).first()["null_mode"] == "global_fallback"
    with pytest.raises(J.CheckFailed):
        bounded(as_rows(spark, ["A" * 100]), limit=10)


def test_label_null_has_the_moments_of_permuted_labels(spark):
    rows, labels, weights, clades = label_rows()
    a, y, w, c = np.array([list(r) for r in rows]), np.array(labels), np.array(weights), np.array(clades).astype(int)

    def score(y):
        mi, h = [], []
        for col in a.T:
            t = pd.DataFrame({"a": col, "y": y, "w": w}).pivot_table(index="a", columns="y", values="w", aggfunc="sum", fill_value=0).to_numpy() / w.sum()
            e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True)
            mi.append((t[t > 0] * np.log2(t[t > 0] / e[t > 0])).sum())
            p = pd.Series(col).value_counts(normalize=True)
            h.append(-(p * np.log2(p)).sum())
        mi, h = np.array(mi), np.array(h)
        return mi - h * mi.mean() / h.mean()

    rng = np.random.default_rng(9)
    null = []
    for _ in range(300):
        moved = y.copy()
        for k in set(c):
            moved[c == k] = rng.permutation(y[c == k])
        null.append(score(moved))
    null, seen = np.array(null), score(y)
    got = {r["match_col"]: r for r in I.label_null(labelled(spark, rows, labels, weights, clades), replicates=300).collect()}
    for k in range(3):
        assert got[k]["mi_bits"] == pytest.approx(seen[k], abs=1e-9)
        assert abs(got[k]["null_mean"] - null[:, k].mean()) < 5 * null[:, k].std() / 300**0.5
        assert abs(got[k]["null_sd"] / null[:, k].std(ddof=1) - 1) < 0.35


# --- alignment --------------------------------------------------------------------------------


def full_programme(a, b):
    """(score, matches) of the best local alignment, of all; more matches win."""
    best, prev = (0, 0), [(0, 0)] * (len(b) + 1)
    for x in a:
        row = [(0, 0)]
        for j, y in enumerate(b, 1):
            d = prev[j - 1] if prev[j - 1][0] > 0 else (0, 0)
            cells = [(d[0] + H.MATCH, d[1] + 1) if x == y else (d[0] + H.MISMATCH, d[1]), (prev[j][0] + H.GAP, prev[j][1]), (row[j - 1][0] + H.GAP, row[j - 1][1])]
            row.append(max(c if c[0] > 0 else (0, 0) for c in cells))
        best, prev = max(best, *row), row
    return best


def mutated(rng, s, edits):
    s = list(s)
    for _ in range(edits):
        k = rng.integers(len(s))
        kind = rng.integers(3)
        if kind == 0:
            s[k] = rng.choice(list("ACDEFGHIKL"))
        elif kind == 1 and len(s) > 5:
            del s[k]
        else:
            s.insert(k, rng.choice(list("ACDEFGHIKL")))
    return "".join(s)


def test_aligned_against_the_full_programme():
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("ACDEFGHIKL"), n))
    pairs = [("", "ACD"), ("A", "A"), ("ACDEF", "ACDEF"), ("AAAA", "CCCC")]
    for _ in range(120):
        s = word(rng.integers(12, 90))
        pairs.append((word(rng.integers(0, 9)) + s + word(rng.integers(0, 9)), mutated(rng, s, rng.integers(0, 10))))
    a, b = map(list, zip(*pairs, strict=True))
    got = H.aligned(a, b)
    want = [full_programme(x, y) for x, y in pairs]
    assert [(int(s), int(m)) for s, m in zip(got["score"], got["matches"], strict=True)] == want
    for k, (x, y) in enumerate(pairs):
        if want[k][0]:
            fa, ta, fb, tb, n = (int(got[c][k]) for c in ("a_from", "a_to", "b_from", "b_to", "columns"))
            assert 0 <= fa <= ta < len(x) and 0 <= fb <= tb < len(y)
            # the places told are those of an alignment of that score, and so is its length
            assert full_programme(x[fa : ta + 1], y[fb : tb + 1]) == want[k] and n >= max(ta - fa, tb - fb) + 1
            mismatches = 2 * n - (ta - fa + 1) - (tb - fb + 1)  # gaps
            assert want[k][0] == H.MATCH * want[k][1] + H.GAP * mismatches + H.MISMATCH * (n - want[k][1] - mismatches)
        else:
            assert got["a_from"][k] == -1


def test_identity_clusters(spark):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("ACDEFGHIKL"), n))
    families = [word(rng.integers(40, 60)) for _ in range(6)]
    rows = [(i, s) for i, s in enumerate([m for f in families for m in [f, f, *[mutated(rng, f, 2) for _ in range(4)]]] + [word(40) for _ in range(3)] + ["AC", None])]
    seqs = spark.createDataFrame(rows, "id long, s string").repartition(3)
    distinct = sorted({s for _, s in rows if s}, key=lambda s: min(i for i, t in rows if t == s))
    first = {s: min(i for i, t in rows if t == s) for s in distinct}
    similar = set()
    for x, y in itertools.combinations(distinct, 2):
        got = H.aligned([x], [y], band=200)
        n = int(got["columns"][0])
        if n and got["matches"][0] / n >= 0.9 and min((got["a_to"][0] - got["a_from"][0] + 1) / len(x), (got["b_to"][0] - got["b_from"][0] + 1) / len(y)) >= 0.8:
            similar.add((min(first[x], first[y]), max(first[x], first[y])))
    one = spark.createDataFrame([(first[s], s) for s in distinct], "id long, s string")
    pairs = H.similar(one, "id", "s").collect()
    found = {(r["u"], r["v"]) for r in pairs}
    assert found <= similar and len(found) >= 0.9 * len(similar) > 25 and all(r["identity"] >= 0.9 and r["coverage"] >= 0.8 for r in pairs)
    got = {r["member"]: r["representative"] for r in H.identity_clusters(seqs.where("s is not null"), "id", "s").collect()}
    reps, want = [], {}
    for s in sorted(distinct, key=lambda s: (-len(s), first[s])):
        hit = [r for r in reps if (min(r, first[s]), max(r, first[s])) in found]
        want[first[s]] = hit[0] if hit else first[s]
        if not hit:
            reps.append(first[s])
    assert got == {i: want[first[s]] for i, s in rows if s}


# --- tree relations ---------------------------------------------------------------------------


def random_tree(seed, n=90, chain=False):
    """{node: (parent, length)} with polytomies and single children; tips are nodes without children."""
    rng = np.random.default_rng(seed)
    up = {"v0": (None, 0.0)}
    for i in range(1, n):
        up[f"v{i}"] = (f"v{i - 1 if chain and i < n // 2 else rng.integers(max(0, i - 12), i)}", float(rng.integers(0, 5)))
    return up


def tree_table(spark, up, rename=lambda x: x):
    depth = lambda x: 0 if up[x][0] is None else 1 + depth(up[x][0])
    inner = {p for p, _ in up.values()}
    rows = [(x, p, length, depth(x), x not in inner, rename(x) if x not in inner else None) for x, (p, length) in up.items()]
    return spark.createDataFrame(rows, "node string, parent string, branch_length double, depth int, is_tip boolean, name string").repartition(3)


def path(up, x):
    out = [x]
    while up[out[-1]][0] is not None:
        out.append(up[out[-1]][0])
    return out


def tips_below(up):
    inner = {p for p, _ in up.values()}
    below = {x: set() for x in up}
    for x in up:
        if x not in inner:
            for node in path(up, x):
                below[node].add(x)
    return below


def test_tree_relations(spark):
    up = random_tree(2, 20, True)
    t, below = tree_table(spark, up), tips_below(up)
    lab = {r["node"]: r for r in P.labelled(t).collect()}
    tips = {lab[x]["first"]: x for x in up if lab[x]["is_tip"]}
    assert sorted(tips) == list(range(len(tips)))
    for x in up:
        assert {tips[k] for k in range(lab[x]["first"], lab[x]["last"] + 1)} == below[x] and lab[x]["n"] == len(below[x])
        assert lab[x]["distance"] == sum(up[y][1] for y in path(up, x))
    for size in (4,):
        got = {r["tip"]: r["clade"] for r in P.clade_cut(t, size).collect()}
        assert got == {x: [y for y in path(up, x) if len(below[y]) <= size][-1] for x in tips.values()}
    pairs = [(a, b) for a in up for b in list(up)[::7]]
    got = {(r["a"], r["b"]): r["distance"] for r in P.patristic_pairs(t, spark.createDataFrame(pairs, "a string, b string")).collect()}
    for a, b in pairs:
        m = next(y for y in path(up, a) if y in path(up, b))
        assert got[a, b] == sum(up[y][1] for x in (a, b) for y in path(up, x)) - 2 * sum(up[y][1] for y in path(up, m))
    some = spark.createDataFrame([(x,) for x in list(tips.values())[:5]], "tip string")
    assert len(P.patristic(t, some).collect()) == 10


def test_splits_and_rf_null(spark, monkeypatch):
    up, other = random_tree(3, 30), random_tree(4, 30)
    names = sorted(tips_below(up)["v0"])
    # the second tree gets the first one's tips, as many as it has
    theirs = sorted(tips_below(other)["v0"])
    k = min(len(names), len(theirs))
    keep = lambda up, tips: {x: v for x, v in up.items() if any(t in tips_below(up)[x] for t in tips)}
    up, other = keep(up, names[:k]), keep(other, theirs[:k])
    back = dict(zip(theirs[:k], names[:k], strict=True))
    a, b = tree_table(spark, up), tree_table(spark, other, lambda x: back[x])
    every = set(names[:k])
    sa = {frozenset([frozenset(s), frozenset(every - s)]) for s in tips_below(up).values() if 2 <= len(s) <= k - 2}
    sb = {frozenset(frozenset(back[t] for t in side) for side in s) for s in [frozenset([frozenset(x), frozenset(set(theirs[:k]) - x)]) for x in tips_below(other).values() if 2 <= len(x) <= k - 2]}
    got = P.robinson_foulds(a, b).first()
    assert (got["shared"], got["only_a"], got["only_b"]) == (len(sa & sb), len(sa - sb), len(sb - sa))
    assert P.robinson_foulds(a, a).first()["rf_distance"] == 0
    same = P.robinson_foulds_test(a, a, replicates=19).first()
    assert same["rf_distance"] == 0 and same["p_value"] == pytest.approx(0.05) and same["null_mean"] > 0
    with pytest.raises(J.CheckFailed):
        monkeypatch.setattr(P, "TIPS", 3)
        P.patristic(a, a.where("is_tip").select(F.col("node").alias("tip")))


def test_relabelled_permutes(spark):
    tips = spark.createDataFrame([(f"t{i}",) for i in range(23)], "tip string")
    got = P.relabelled(tips, 5).collect()
    for r in range(5):
        mine = [(x["tip"], x["to"]) for x in got if x["r"] == r]
        assert sorted(a for a, _ in mine) == sorted(b for _, b in mine) == sorted(f"t{i}" for i in range(23))
    assert len({tuple(sorted((x["tip"], x["to"]) for x in got if x["r"] == r)) for r in range(5)}) == 5


# --- statistics -------------------------------------------------------------------------------


def test_bh_without_groups(spark, monkeypatch):
    monkeypatch.setattr(T, "BUCKET", 4)
    rng = np.random.default_rng(4)
    rows = [(i, None if i % 9 == 0 else float(np.round(rng.random() ** 3, 2))) for i in range(60)]
    got = {r["i"]: r["q_bh"] for r in T.bh_adjust(spark.createDataFrame(rows, "i int, p double"), "p", ["i"]).collect()}
    known = sorted(((p, i) for i, p in rows if p is not None), reverse=True)
    low = 1.0
    for k, (p, i) in enumerate(known):
        low = min(low, p * len(known) / (len(known) - k))
        assert got[i] == pytest.approx(low, abs=1e-12)
    assert len(got) == 60 and all(got[i] is None for i, p in rows if p is None)


def test_special_functions():
    assert special.gammainc_upper(3.0, 2.0) == pytest.approx(5 * math.exp(-2), abs=1e-12)
    assert special.gammainc_upper(3.0, 9.0) == pytest.approx(50.5 * math.exp(-9), abs=1e-12)
    assert special.betainc(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-9)
    assert special.student_t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert float(special.normal_sf(1.959964)) == pytest.approx(0.025, abs=1e-6)


def test_fisher(spark):
    df = spark.createDataFrame([(8, 10, 9, 20), (0, 3, 2, 9), (300, 400, 500, 1000)], "n11 long, n1x long, nx1 long, nxx long")

    def tail(a, r, c, n):
        return sum(math.comb(r, k) * math.comb(n - r, c - k) for k in range(a, min(r, c) + 1)) / math.comb(n, c)

    for r in T.fisher_greater(df).collect():
        assert r["p"] == pytest.approx(tail(r["n11"], r["n1x"], r["nx1"], r["nxx"]), rel=1e-7)


def test_agreement_indices(spark):
    same = spark.createDataFrame([(1, 1, 5), (2, 2, 7)], "a long, b long, n long")
    assert T.adjusted_rand(same, "a", "b").first()["adjusted_rand"] == pytest.approx(1)
    assert T.adjusted_mutual_information(same, "a", "b") == pytest.approx(1)
    apart = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (2, 1, 5), (2, 2, 5)], "a long, b long, n long")
    assert abs(T.adjusted_mutual_information(apart, "a", "b")) < 0.1


# --- graph and tree ---------------------------------------------------------------------------


def test_components_against_union_find(spark):
    rng = np.random.default_rng(3)
    edges = {tuple(sorted(map(int, rng.choice(60, 2, replace=False)))) for _ in range(45)}
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = G.components(spark.range(60), spark.createDataFrame(list(edges), "u long, v long")).collect()
    assert {r["node"]: r["component"] for r in got} == {i: find(i) for i in range(60)}
    assert [r["size"] for r in sorted(got, key=lambda r: r["rank"])][0] == max(r["size"] for r in got)


def test_long_path_component(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    assert {r["component"] for r in G.components(spark.range(41), e).collect()} == {0}


def test_greedy_clusters(spark):
    s = spark.createDataFrame([(1, "ABCDEFGHIJ"), (2, "ABCDEFGHI"), (3, "BCDEFGHI"), (4, "QRSTUVW")], "id long, seq string")
    pairs = G.kmer_similarity(s, "id", "seq", 4, 0.5)
    got = {r[0]: r[1] for r in G.greedy_clusters(s.withColumn("len", F.length("seq")), "id", "len", pairs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def balanced(n):
    rows, level, k = [], [0], 0
    rows.append((0, None, 0.0, 0, n == 1, "t0"))
    depth = 0
    while len(level) < n:
        depth += 1
        new = []
        for p in level:
            for _ in range(2):
                k += 1
                rows.append((k, p, 1.0, depth, len(level) * 2 == n, f"t{k}"))
                new.append(k)
        level = new
    return pd.DataFrame(rows, columns=["node", "parent", "branch_length", "depth", "is_tip", "name"]), level


def test_fitch_clumped_and_scattered(spark):
    t, tips = balanced(32)
    rows = [(int(n), None if p != p else int(p), float(b), int(d), bool(k), name) for n, p, b, d, k, name in t.itertuples(index=False)]
    tree = spark.createDataFrame(rows, "node long, parent long, branch_length double, depth int, is_tip boolean, name string")
    for state, want in (({x: int(i < 8) for i, x in enumerate(tips)}, 1), ({x: int(i % 4 == 0) for i, x in enumerate(tips)}, 8)):
        s = spark.createDataFrame(list(state.items()), "node long, state int")
        assert P.fitch(tree, P.tip_masks(tree, s)).first()[0] == want
        row = P.convergence(spark, t, state, replicates=30).first()
        assert row["parsimony_changes"] == want
        assert (row["clustering_index"] < 0.25) == (want == 1)


def test_nulls_have_the_prevalence_and_never_meet_on_the_driver(spark, monkeypatch):
    rows = spark.createDataFrame([(r, float(v)) for r in range(2) for v in np.random.default_rng(r).normal(size=500)], "r int, v double")
    monkeypatch.setattr(P, "BINS", 8)
    for k in (0, 1, 250, 499):
        cut = {r["r"]: r["cut"] for r in P.cuts(rows, "v", k, 2, -50.0, 50.0).collect()}
        assert len(cut) == 2 and {r["r"]: r["count"] for r in rows.where(F.col("v") > F.when(F.col("r") == 0, cut[0]).otherwise(cut[1])).groupBy("r").count().collect()} == ({0: k, 1: k} if k else {})
    normal = spark.range(20_000).select(P._normal(F.lit(1), F.lit(7), F.col("id")).alias("x")).agg(F.avg("x"), F.stddev_samp("x"), F.kurtosis("x")).first()
    assert abs(normal[0]) < 0.03 and abs(normal[1] - 1) < 0.03 and abs(normal[2]) < 0.15
    tree = spark.createDataFrame([(0, None, 0.0, 0, False)] + [(i, 0, 1.0, 1, True) for i in range(1, 9)], "node long, parent long, branch_length double, depth int, is_tip boolean")
    for marked, want in ((8, 0), (0, 0), (3, 1)):
        state = spark.createDataFrame([(i, 1) for i in range(1, marked + 1)], "node long, state int")
        row = P.convergence(spark, tree, state, replicates=3).first()
        assert (row["n_tips"], row["prevalence"], row["parsimony_changes"]) == (8, marked / 8, want) and row["null_random_mean"] == row["null_brownian_mean"] == want


def test_polytomy(spark):
    tree = spark.createDataFrame([(0, None, 0, False), (1, 0, 1, True), (2, 0, 1, True), (3, 0, 1, True)], "node long, parent long, depth int, is_tip boolean")
    s = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "node long, state int")
    assert P.fitch(tree, P.tip_masks(tree, s)).first()[0] == 1


def test_upgma():
    d = np.array([[0, 2, 8.0], [2, 0, 8], [8, 8, 0]])
    t = P.upgma(d, ["a", "b", "c"])
    assert t.loc[t.name == "a", "parent"].iloc[0] == t.loc[t.name == "b", "parent"].iloc[0]
    assert t.loc[t.name == "a", "branch_length"].iloc[0] == 1


# --- intervals and order ----------------------------------------------------------------------


def greedy(hits, limit=0.4):
    kept = []
    for h in sorted(hits):
        clash = False
        for k in kept:
            both = min(h[2], k[2]) - max(h[1], k[1]) + 1
            clash |= both > 0 and both / (min(h[2] - h[1], k[2] - k[1]) + 1) > limit
        if not clash:
            kept.append(h)
    return sorted((k[1], k[2]) for k in kept)


def test_resolve_overlaps_against_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i % 12), float(np.round(rng.random(), 3)), int(a), int(a + rng.integers(0, 30)), i) for i, a in enumerate(rng.integers(0, 80, 150))]
    df = spark.createDataFrame(rows, "item long, ev double, a int, b int, i long")
    got = {}
    for r in IV.resolve_overlaps(df, "item", "a", "b", [F.col("ev"), F.col("i")]).collect():
        got.setdefault(r["item"], []).append((r["a"], r["b"]))
    for item in range(12):
        assert sorted(got[item]) == greedy([(ev, a, b, i) for k, ev, a, b, i in rows if k == item])


@pytest.mark.parametrize("hot", [10**9, 20])
def test_resolve_overlaps_of_hot_items(spark, monkeypatch, hot):
    """With and without dealing items by cluster: nulls, ends before starts, null items, long clusters."""
    monkeypatch.setattr(IV, "HOT_ROWS", hot)
    rng = np.random.default_rng(8)
    rows = []
    for item, n, wide in (("hot", 400, 3000), ("dense", 300, 60), ("few", 6, 30), (None, 40, 90)):
        for a in rng.integers(0, wide, n):
            rows.append((item, float(np.round(rng.random(), 2)), int(a), int(a + rng.integers(-3, 40)), len(rows)))
    rows += [("hot", 0.5, None, 3, 9000), ("hot", 0.5, 3, None, 9001), ("few", None, 4, 9, 9002)]
    df = spark.createDataFrame(rows, "item string, ev double, a int, b int, i long").repartition(5)
    got = sorted((r["item"] or "", r["i"]) for r in IV.resolve_overlaps(df, "item", "a", "b", [F.col("ev"), F.col("i")]).collect())
    want = []
    for item in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == item]
        want += [(item or "", r[4]) for r in mine if r[2] is None or r[3] is None or r[3] < r[2]]
        kept = []
        for _, _, a, b, i in sorted((r for r in mine if None not in r[2:4] and r[3] >= r[2]), key=lambda r: (r[1] is not None, r[1] or 0, r[4])):
            if not any(min(b, y) >= max(a, x) and (min(b, y) - max(a, x) + 1) / (min(b - a, y - x) + 1) > 0.4 for x, y, _ in kept):
                kept.append((a, b, i))
        want += [(item or "", i) for _, _, i in kept]
    assert got == sorted(want)


def test_resolve_overlaps_of_a_million_hits(spark):
    """A million hits of one item, which are dealt by cluster; some ten for each place."""
    hits = spark.range(1_000_000).select(F.lit("one").alias("item"), (F.col("id") % 99991 * 7).cast("int").alias("a"), F.col("id").alias("ev"))
    kept = IV.resolve_overlaps(hits.withColumn("b", F.col("a") + 9), "item", "a", "b", [F.col("ev")])
    assert kept.count() == 99991 and kept.agg(F.max("ev")).first()[0] == 99990


def test_run_lengths(spark):
    df = spark.createDataFrame([(["A", "A", "B", "A"],), (["C"],), ([],), (["B"] * 3,)], "l array<string>")
    assert [r[0] for r in df.select(IV.run_lengths(F.col("l"))).collect()] == ["Ax2-B-A", "C", "", "Bx3"]


def test_architecture_classes(spark):
    rows = [("full", "N", 1, 30, 1e-9), ("full", "N", 41, 70, 1e-9), ("full", "N", 81, 110, 1e-9), ("full", "R", 150, 240, 1e-9)]
    rows += [("edge", "N", 1, 30, 1e-9), ("edge", "N", 41, 70, 1e-3), ("edge", "N", 81, 110, 1e-3), ("edge", "R", 150, 240, 1e-9)]
    rows += [("less", "N", 1, 30, 1e-9), ("less", "N", 41, 70, 1e-9), ("less", "R", 150, 240, 1e-9)]
    h = spark.createDataFrame(rows, "item string, label string, a int, b int, ev double")
    cut = lambda e: IV.resolve_overlaps(h.where(F.col("ev") <= e), "item", "a", "b", [F.col("ev"), F.col("a")])
    items = spark.createDataFrame([("full",), ("edge",), ("less",), ("bare",)], "item string")
    got = {r["item"]: r for r in IV.architecture_table(items, cut(1e-5), cut(1e-2), "item", "a", "b", "label", "N", "R", ["A"]).collect()}
    assert {k: r["architecture_class"] for k, r in got.items()} == {"full": "canonical", "edge": "count_ambiguous", "less": "reduced", "bare": "catalytic_only"}
    assert got["full"]["architecture"] == "Nx3-R" and got["full"]["binding_span"] == "1-30;41-70;81-110"
    assert (got["edge"]["n_binding"], got["edge"]["n_binding_permissive"]) == (1, 3)


def test_synteny_statuses(spark):
    def genome(name, places):
        return [(name, f"{name}{i}", role) for i, (role, _, _) in enumerate(places)], [(name, f"{name}{i}", c, 100 * o, 100 * o + 50, o) for i, (_, c, o) in enumerate(places) if c]

    lig, mray, cps = Y.ROLES
    cases = {"near": [(lig, "c", 5), (mray, "c", 6), (cps, "c", 7)], "split": [(lig, "c", 5), (mray, "d", 6), (cps, "d", 7)], "many": [(lig, "c", 5), (mray, "d", 6), (cps, "d", 7)], "lost": [(lig, "c", 5), (mray, None, 0), (cps, "c", 7)], "far": [(lig, "c", 5), (mray, "c", 40), (cps, "c", 78)]}
    made = [genome(k, v) for k, v in cases.items()]
    hits = spark.createDataFrame([x for h, _ in made for x in h], "g string, item string, role string")
    coords = spark.createDataFrame([x for _, c in made for x in c], "g string, item string, contig string, start int, end int, order int")
    contigs = spark.createDataFrame([("near", 3), ("split", 3), ("many", 500), ("lost", 3), ("far", 3)], "g string, n_contigs int")
    got = {r["g"]: r for r in Y.block_synteny(hits, coords, contigs, "g", "item").collect()}
    assert {k: r["status"] for k, r in got.items()} == {"near": "syntenic", "split": "dispersed", "many": "not_evaluable", "lost": "not_evaluable", "far": "dispersed"}
    assert got["far"]["span_genes"] == 73


# --- lookups, clustering, models --------------------------------------------------------------


def test_wall_lookup(spark):
    df = spark.createDataFrame([("s__Methanobrevibacter ruminantium",), ("s__Methanobrevibacter oralis",), ("s__Methanobacterium congolense",), ("s__Methanosphaera stadtmanae",), ("s__Methanospirillum hungatei",), (None,)], "species string")
    got = {r["species"]: (r["p1"], r["p1_source"]) for r in R.wall_chemistry(df).collect()}
    assert got["s__Methanobrevibacter ruminantium"] == ("Thr", "literature_type_strain")
    assert got["s__Methanobrevibacter oralis"] == ("unknown", "genus_heterogeneous")
    assert got["s__Methanobacterium congolense"] == ("Ala", "literature_genus_homogeneous")
    assert got["s__Methanosphaera stadtmanae"][0] == "unsupported"
    assert got["s__Methanospirillum hungatei"][0] == "no_pseudomurein"
    assert got[None] == ("unknown", "none")


def test_rule_can_be_falsified(spark):
    a = R.agreement(R.rule_vs_measured(spark)).first()
    assert a["n_nontrivial"] == a["n_nontrivial_agree"] > 0
    wrong = R.values(spark, [(s, "Ala", q, lv) for s, _, q, lv in R.CHEMISTRY], "_sp", "_p1", "_p1p", "_level")
    b = R.agreement(R.rule_vs_measured(spark, chemistry=wrong)).first()
    assert b["n_nontrivial_agree"] < b["n_nontrivial"]


def test_spacing_candidates(spark):
    assert one(spark, R.spacing_candidates(F.lit("ACAHAAH"), F.lit(2), "H")) == [2, 5]
    assert one(spark, R.spacing_candidates(F.lit("ACAHAAH"), F.lit(2), "H", 6, 1)) == [5]


def test_links_have_the_components_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 16)
    monkeypatch.setattr(D, "CHUNK", 3)
    x = np.random.default_rng(3).normal(size=(150, 12)).round(3)
    x[20:24] = x[19]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(200, None), (201, [0.0] * 12)], "id long, v array<double>")
    bars = [0.5, 0.6, 0.7, 0.8, 0.9]
    unit = x / np.sqrt((x**2).sum(1))[:, None]
    cos = np.round(unit @ unit.T, 6)
    edges, counts = D.links_above(rows, "id", "v", bars)
    pairs = [(i, j, float(cos[i, j])) for i in range(150) for j in range(i + 1, 150) if cos[i, j] >= 0.5]
    assert {r[0]: r[1] for r in counts.collect()} == {t: n for t in bars if (n := sum(c >= t for _, _, c in pairs))}
    assert edges.count() < len(pairs) and {(min(r[0], r[1]), max(r[0], r[1])) for r in edges.collect()} <= {(i, j) for i, j, _ in pairs}
    full = spark.createDataFrame(pairs, "u long, v long, score double")
    sweep = lambda e, *more: sorted(tuple(r) for r in G.threshold_sweep(rows.select("id"), e, "score", bars, *more).collect())
    assert sweep(edges, counts) == sweep(full)
    assert sorted((r["u"], r["v"], round(r["cosine"], 6)) for r in D.edges_above(rows, "id", "v", 0.5).collect()) == [(i, j, round(c, 6)) for i, j, c in pairs]


def test_canonical_edges(spark):
    e = spark.createDataFrame([(2, 1, 0.5), (1, 2, 0.3), (1, 1, 0.0), (1, 9, 0.1), (3, 2, 0.2)], "a long, b long, evalue double")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "n long")
    assert sorted(tuple(r) for r in G.canonical_edges(e, nodes).collect()) == [(1, 2, 0.3), (2, 3, 0.2)]


def test_nearest_rows_are_held_by_the_task(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 8)
    monkeypatch.setattr(D, "CHUNK", 2)
    x = np.random.default_rng(4).integers(0, 4, size=(70, 3)).astype(float)  # many ties
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>")
    got = {(r["u"], r["rank"]): (r["v"], r["d"]) for r in D.neighbours(df, "id", "v", 4).collect()}
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(70):
        want = sorted((gap[i, j], j) for j in range(70) if j != i)[:4]
        assert [got[i, k + 1] for k in range(4)] == [(j, pytest.approx(d)) for d, j in want]
    # a task gives some rows for each query row, not some for each pair of blocks
    blocks = D.packed(df, "id", "v").coalesce(1)
    assert D.meet(blocks, blocks, lambda: D.Nearest(4), "u long, v long, d double", held=True).groupBy("u").count().agg(F.max("count")).first()[0] <= 4


def test_embedding_reduced_in_its_task(spark):
    e = C.Embedding({"A": [3.0, 0.0], "C": [0.0, 4.0]}, [1.0, 1.0], unit=True, values=["x", "y"])
    df = spark.createDataFrame([("AC", "x"), ("", "y"), ("é字A", None), ("A-C", "z"), ("CA", "y")], "row string, kind string")

    def keep(values, length):
        ends = np.cumsum(length)
        return {"n": length.astype(np.int32), "last": values[ends - 1], "sum": np.add.reduceat(values, ends - length)}

    got = {r["row"]: (r["d"]["n"], r["d"]["last"], round(r["d"]["sum"], 9)) for r in df.select("row", e.reduced("row", "kind", keep, "n int, last double, sum double").alias("d")).collect()}
    assert got == {"AC": (6, 0.0, 2.4), "": (2, 1.0, 1.0), "é字A": (8, 0.0, 0.0), "A-C": (8, 0.0, 1.0), "CA": (6, 1.0, 2.4)}
    whole = C.dummies(C.one_hot(df, "row", "AC"), "kind", ["x", "y"])
    assert {r["row"]: len(r["vector"]) for r in whole.collect()} == {k: v[0] for k, v in got.items()}


def test_max_min(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [10.0, 0.0]), (3, [0.0, 5.0]), (4, [0.0, 0.0])], "id long, v array<double>")
    assert [r["id"] for r in C.max_min(df, "id", "v", 4, [0]).orderBy("step").collect()] == [0, 2, 3, 1]
    assert len(C.max_min(df, "id", "v", 5, [0]).collect()) == 4


def test_embedding_and_pca(spark):
    m = C.standardised(C.parse_substitution_matrix("  A C\nA 4 0\nC 0 9\n"))
    rows = C.embed(spark.createDataFrame([("AC",), ("A-",)], "row string"), F.col("row"), m, [1.0, 0.5])
    got = {r["row"]: r["vector"] for r in rows.collect()}
    assert got["A-"][2:] == [0, 0] and got["AC"][3] == pytest.approx(m["C"][1] / 2)
    rng = np.random.default_rng(0)
    pts = spark.createDataFrame([([float(a), float(2 * a), float(b)],) for a, b in rng.normal(size=(50, 2))], "v array<double>")
    out, var = C.pca(pts, "v", 2)
    assert sum(var) == pytest.approx(1, abs=1e-6)
    assert abs(out.agg(F.avg(F.col("pc")[0])).first()[0]) < 1e-9


def dense_tree(x, ids, min_size):
    """Prim over the whole matrix of mutual reachability: {(a, b): w}."""
    d = np.sqrt(np.maximum(np.round(((x[:, None] - x[None]) ** 2).sum(2), 10), 0))
    core = np.sort(d, axis=1)[:, min(min_size, len(x)) - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    inside, out = {0}, {}
    while len(inside) < len(x):
        w, a, b = min((reach[i, j], min(ids[i], ids[j]), max(ids[i], ids[j])) for i in inside for j in range(len(x)) if j not in inside)
        out[a, b] = w
        inside |= {list(ids).index(a), list(ids).index(b)}
    return out


def dense_labels(tree, ids, min_size):
    """Sets of ids of the stablest clusters, from the top down by cutting the tree's heaviest edges."""

    def pieces(edges, nodes):
        left = {i: {i} for i in nodes}
        for a, b in edges:
            both = left[a] | left[b]
            for k in both:
                left[k] = both
        return {frozenset(v) for v in left.values()}

    def best(nodes, birth, whole):
        edges = {e: w for e, w in tree.items() if set(e) <= nodes}
        stability, now = 0.0, nodes
        for e, w in sorted(edges.items(), key=lambda x: (-x[1], -x[0][0], -x[0][1])):
            if not set(e) <= now:
                continue
            lam = 1 / w
            edges = {k: v for k, v in edges.items() if set(k) <= now and k != e}
            two = pieces(edges, now)
            big = [p for p in two if len(p) >= min_size]
            if len(big) == 2:
                stability += len(now) * (lam - birth)
                below = [best(p, lam, False) for p in big]
                total = sum(s for s, _ in below)
                return (total, [c for _, cs in below for c in cs]) if whole or total > stability else (stability, [frozenset(nodes)])
            stability += sum(len(p) for p in two if p not in big) * (lam - birth)
            if not big:
                break
            now = big[0]
        return (0.0, []) if whole else (stability, [frozenset(nodes)])

    return set(best(frozenset(ids), 0.0, True)[1])


@pytest.mark.parametrize(("seed", "block", "listed"), [(0, 1024, 10), (1, 9, 2)])
def test_density_clusters(spark, monkeypatch, seed, block, listed):
    monkeypatch.setattr(DC.V, "BLOCK", block)
    monkeypatch.setattr(DC.V, "CHUNK", 2)
    monkeypatch.setattr(DC, "LIST", listed)
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, 0.3, (16, 2)), rng.normal(4, 0.2, (14, 2)), rng.normal((0, 6), 0.5, (12, 2)), rng.uniform(-9, 9, (8, 2))])
    ids = rng.permutation(500)[:50]
    df = spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(ids, x, strict=True)], "k long, v array<double>")
    want = dense_tree(x, ids, 4)
    tree = {(r["a"], r["b"]): r["w"] for r in DC.spanning_tree(df, "k", "v", 4).collect()}
    assert tree.keys() == {(int(a), int(b)) for a, b in want} and all(w == pytest.approx(want[e], abs=1e-9) for e, w in tree.items())
    got = {}
    for r in DC.density_clusters(df.unionByName(spark.createDataFrame([(None, [1.0, 1.0]), (999, None)], df.schema)), "k", "v", 4).collect():
        got.setdefault(r["cluster"], set()).add(r["id"])
    found = dense_labels({(int(a), int(b)): w for (a, b), w in want.items()}, ids.tolist(), 4)
    assert {frozenset(v) for c, v in got.items() if c >= 0} == found and len(found) >= 2 and sum(map(len, got.values())) == 50


def test_density_of_few_rows(spark):
    df = lambda rows: spark.createDataFrame(rows, "k long, v array<double>")
    assert [r["cluster"] for r in DC.density_clusters(df([(1, [0.0]), (2, [1.0])]), "k", "v", 3).collect()] == [-1, -1]
    assert DC.density_clusters(df([]), "k", "v", 3).collect() == []
    assert {r["cluster"] for r in DC.density_clusters(df([(i, [0.0]) for i in range(9)]), "k", "v", 3).collect()} == {-1}


def test_parallel_analysis(spark, monkeypatch):
    monkeypatch.setattr(DC.V, "BLOCK", 100)
    rng = np.random.default_rng(5)
    turned = np.linalg.qr(rng.normal(size=(8, 8)))[0]
    x = rng.normal(size=(900, 3)) * [5, 4, 4.5] @ turned[:3] + rng.normal(size=(900, 8)) + 7
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "k long, v array<double>").repartition(3)
    k, seen, bars = DC.V.parallel_analysis(df, "k", "v")
    values = lambda m: np.sort(np.linalg.eigvalsh(np.cov(m.T)))[::-1]
    null = np.quantile([values(rng.permuted(x, axis=0)) for _ in range(100)], 0.95, axis=0)
    assert k == 3 and np.allclose(seen, values(x), rtol=1e-9) and np.allclose(bars, null, rtol=0.05)
    noise = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(rng.normal(size=(500, 4)))], "k long, v array<double>")
    assert DC.V.parallel_analysis(noise, "k", "v")[0] == 2


def test_models(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 + 1.5 * x)))).astype(int)
    df = spark.createDataFrame([(int(b), float(a), 1.0) for a, b in zip(x, y, strict=True)], "y int, x double, c double")
    fit = {r["term"]: r for r in M.logit_glm(df, "y", ["x", "c"]).collect()}
    assert set(fit) == {"x", "(Intercept)"} and 1.0 < fit["x"]["estimate"] < 2.1
    b, _ = M.firth(np.column_stack([np.ones(400), x]), y)
    assert b[1] == pytest.approx(fit["x"]["estimate"], abs=0.1)
    b, _ = M.firth(np.ones((6, 1)), np.ones(6))
    assert np.isfinite(b).all()
    prev = M.adjusted_prevalence(pd.DataFrame({"y": [0, 0, 1, 0, 1, 1], "g": list("aaabbb"), "x": range(6)}), "y", "g", ["x"])
    assert ((prev.lower < prev.prevalence) & (prev.prevalence < prev.upper)).all()
    fits = spark.createDataFrame([(r, "x", 1.0 + 0.1 * r, 0.2) for r in range(5)], "replicate int, term string, estimate double, se double")
    p = M.with_t(M.rubin_pool(fits)).first()
    assert p["estimate"] == pytest.approx(1.2) and 0 < p["p"] < 0.05 and 0 < p["fmi"] < 1
    assert M.stratified(df, "y", "x", 3).count() == 6
    with pytest.raises(ValueError):
        M.usable(df.where("y = 1"), "y", ["x"])


def test_phylogenetic_signal():
    t, tips = balanced(32)
    clumped = M.binary_d(t, {x: int(i < 8) for i, x in enumerate(tips)}, replicates=60)
    scattered = M.binary_d(t, {x: int(i % 4 == 0) for i, x in enumerate(tips)}, replicates=60)
    assert clumped["d"] < scattered["d"]


def small_tree(seed=6, n=14):
    up = random_tree(seed, n)
    inner = {p for p, _ in up.values()}
    nodes = pd.DataFrame([(x, p, length + 0.5 if p else 0.0, len(path(up, x)) - 1, x not in inner) for x, (p, length) in up.items()], columns=["node", "parent", "branch_length", "depth", "is_tip"])
    return up, nodes, [x for x in up if x not in inner]


def test_pruned_likelihood_against_all_histories():
    up, nodes, tips = small_tree()
    shape, rng = L.Shape(nodes, tips), np.random.default_rng(1)
    mu, y, alpha = rng.uniform(0.1, 0.9, len(tips)), rng.integers(0, 2, len(tips)), 0.3
    m, length = mu.mean(), dict(zip(nodes["node"], nodes["branch_length"], strict=True))
    total = 0.0
    for states in itertools.product([0, 1], repeat=len(up)):
        s = dict(zip(up, states, strict=True))
        p = m if s["v0"] else 1 - m
        for x, (parent, _) in up.items():
            if parent:
                e = math.exp(-alpha * length[x])
                one = m + (1 - m) * e if s[parent] else m * (1 - e)
                p *= one if s[x] else 1 - one
        for x, mu_x, y_x in zip(tips, mu, y, strict=True):
            one = min(1, mu_x / m) if s[x] else max(0, 1 - (1 - mu_x) / (1 - m))
            p *= one if y_x else 1 - one
        total += p
    assert L.log_likelihood(shape, y, mu, alpha) == pytest.approx(math.log(total), abs=1e-9)


def test_information_against_the_dense_matrix():
    up, nodes, tips = small_tree(8, 40)
    shape, rng = L.Shape(nodes, tips), np.random.default_rng(2)
    x, mu = np.column_stack([np.ones(len(tips)), rng.normal(size=(len(tips), 2))]), rng.uniform(0.1, 0.9, len(tips))
    length = dict(zip(nodes["node"], nodes["branch_length"], strict=True))
    for alpha in (0.02, 0.3, 2.0):
        v = np.array([[math.exp(-alpha * sum(length[z] for z in set(path(up, a)) ^ set(path(up, b)))) for b in tips] for a in tips])
        w = x * np.sqrt(mu * (1 - mu))[:, None]
        assert np.allclose(L.information(shape, x, mu, alpha), w.T @ np.linalg.inv(v) @ w, rtol=1e-7)


def test_fit_is_a_maximum():
    up, nodes, tips = small_tree(9, 160)
    shape, rng = L.Shape(nodes, tips), np.random.default_rng(3)
    x = np.column_stack([np.ones(len(tips)), rng.normal(size=len(tips))])
    y = (rng.random(len(tips)) < 1 / (1 + np.exp(-(0.3 + 1.4 * x[:, 1])))).astype(float)
    got = L.fit(shape, x, y)

    def value(b, alpha):
        mu = 1 / (1 + np.exp(-x @ b))
        return L.log_likelihood(shape, y, mu, alpha) + 0.5 * np.linalg.slogdet(L.information(shape, x, mu, alpha))[1]

    best = value(got["coefficients"], got["alpha"])
    assert best == pytest.approx(got["loglik"], abs=1e-6) and 0.5 < got["coefficients"][1] < 3
    for step in (-0.05, 0.05):
        assert value(got["coefficients"] + [step, 0], got["alpha"]) < best + 1e-9 and value(got["coefficients"] + [0, step], got["alpha"]) < best + 1e-9
        if "alpha" not in got["discarded"]:
            assert value(got["coefficients"], got["alpha"] * (1 + step)) < best + 1e-6


def test_phylogenetic_logit_counts_what_it_discards(spark, monkeypatch):
    up, nodes, tips = small_tree(5, 80)
    t = spark.createDataFrame([tuple(None if v is None else v for v in r) for r in nodes.itertuples(index=False)], "node string, parent string, branch_length double, depth int, is_tip boolean")
    rng = np.random.default_rng(1)
    rows = [(x, int(rng.random() < 0.4), float(rng.normal())) for x in tips] + [("absent", 1, 0.0), (tips[0], None, 1.0), (tips[1], 1, None)]
    df = spark.createDataFrame(rows, "tip string, y int, x double")
    alone = L.phylogenetic_logit(t, df, "tip", "y", ["x"], max_tips=500, min_each=5).collect()
    assert {r["n_replicates"] for r in alone} | {r["n_discarded"] for r in alone} <= {0, 1, None}
    some = L.phylogenetic_logit(t, df, "tip", "y", ["x"], max_tips=20, replicates=3, min_each=5).collect()
    assert all((r["n_replicates"] or 0) + r["n_discarded"] == 3 for r in some)
    assert [r["term"] for r in L.phylogenetic_logit(t, df, "tip", "y", ["x"], min_each=500).collect()] == [None]
    fits = L.replicate_fits(t, L.subsamples(df.dropna().where("tip != 'absent'"), "tip", "y", 20, 2), "tip", "y", ["x"]).collect()
    assert {(r["r"], r["term"]) for r in fits} == {(r, term) for r in (0, 1) for term in ("x", "(Intercept)")} and {r["n_tips"] for r in fits} == {20} and {r["n_positive"] for r in fits} <= set(range(11))


def test_gap_statistic(spark):
    rng = np.random.default_rng(0)
    pts = np.concatenate([rng.normal(c, 0.05, (15, 2)) for c in (0, 3, 6)])
    df = C.normalised(spark.createDataFrame([([float(v) for v in p],) for p in pts + 1], "v array<double>"), "v")
    k, table = C.gap_statistic(df, 1, 3, references=2)
    assert k in (1, 2, 3) and len(table) == 3


# --- the rest ---------------------------------------------------------------------------------


def test_numbered(spark):
    df = spark.createDataFrame([(i * 7 % 50, i) for i in range(200)], "a long, b long")
    got = sorted(((r["a"], -r["b"]), r["rank"]) for r in numbered(df, [F.col("a"), F.col("b").desc()]).collect())
    assert [n for _, n in got] == list(range(200))
    assert numbered(df.limit(0), [F.col("a")]).collect() == []


def test_tree_input(spark):
    rows = spark.createDataFrame([("a", "AC-"), ("b", "AC-"), ("c", "AD-"), ("d", "GD-")], "id string, row string")
    clusters = spark.createDataFrame([("c", "a"), ("a", "a"), ("d", "d")], "member string, representative string")
    tips, prov = P.tree_input(rows, "id", "row", clusters, max_tips=2)
    assert {(r["id"], r["row"]) for r in tips.collect()} == {("a", "AC"), ("d", "GD")}
    got = {r["sequence"]: (r["representative"], r["is_tip"], r["dereplicated"], r["clustered"]) for r in prov.collect()}
    assert got == {"a": ("a", True, False, False), "b": ("a", False, True, False), "c": ("a", False, False, True), "d": ("d", True, False, False)}


def test_seed_and_structure_checks(spark):
    seeds = spark.createDataFrame([("w", "x", 10, 45, [35, 80]), ("r", "y", 10, None, [14, 72])], "name string, family string, anchor int, next int, candidates array<int>")
    level = lambda priors: {r["check"]: r["level"] for r in V.seed_checks(seeds, priors, 5).collect()}
    assert level({"x": 35, "y": None}) == {"seed: w": "OK", "seed: r": "OK"}
    assert level({"x": 35, "y": 35}) == {"seed: w": "OK", "seed: r": "ERROR"}
    pairs = spark.createDataFrame([("A", "A"), ("C", "D")], "structure string, sequence string")
    with pytest.raises(J.CheckFailed):
        V.structure_identity(pairs)
    checked = spark.createDataFrame([(True,), (None,)], "ok boolean")
    assert V.spot_check(checked, "ok", 1.0, 1, "t").first()["level"] == "WARN"
    assert T.cumulative_cut([5.0, 3.0, 2.0], 0.8) == 2


def test_config():
    from evidentia import config

    s = config.screen({"profiles": [{"label": "a"}, {"label": "b", "enabled": False}], "anchor": {"gaps": [35, 24]}})
    assert s.active() == ["a"] and s.anchor.gaps == (35, 24)
    with pytest.raises(ValueError):
        config.screen({"no_such": 1})


def test_yaml_settings(tmp_path):
    from evidentia import config

    pytest.importorskip("yaml")
    p = tmp_path / "screen.yaml"
    p.write_text("profiles:\n- {label: a}\n- {label: b, enabled: false}\nanchor:\n  gaps: [35, 24]\n")
    s = config.load(str(p))
    assert s.active() == ["a"] and s.anchor.gaps == (35, 24)


def test_embedding_places_and_learned_scores(spark):
    rows = spark.createDataFrame([("AC-",), ("",), (None,), ("é字A",)], "row string")
    out = {r["row"]: r["vector"] for r in C.embed(rows, "row", {"A": [1.0, 2.0], "C": [3.0, 4.0]}, [1.0, 0.5]).collect()}
    assert out == {"AC-": [1, 2, 1.5, 2, 0, 0], "": [], None: None, "é字A": [0] * 6}
    hot = {r["row"]: r["vector"] for r in C.dummies(C.one_hot(rows.where("row is not null"), "row", "AC", [3.0, 4.0, 0.0]), "row", [""]).collect()}
    assert hot["AC-"] == [0.6, 0, 0, 0.8, 0, 0, 0] and hot[""] == [1.0] and hot["é字A"] == [0] * 7
    counts = A.counted(spark.createDataFrame([("AC",), ("AA",), ("AC",)], "row string"), [], {"n": None})
    scores = C.log_odds(counts, "ACD")
    # twelve ordered pairs: AA 6 + 0, CC 2, AC and CA 2 each
    share = {"A": 8 / 12, "C": 4 / 12}
    assert scores["A"] == pytest.approx([math.log2(6 / 12 / share["A"] ** 2), math.log2(2 / 12 / share["A"] / share["C"]), 0.0])
    assert scores["D"] == [0.0] * 3 and C.log_odds(counts.where("false"), "AC") == {"A": [0.0] * 2, "C": [0.0] * 2}


def test_first_members_and_reach(spark):
    d = spark.createDataFrame([("x", 2, "b"), ("x", 1, "a"), (None, 5, "n"), ("y", 3, None)], "c string, k int, v string")
    assert sorted(map(tuple, C.first_in_cluster(d, "c", "k").collect()), key=str) == sorted([("x", 1, "a"), (None, 5, "n"), ("y", 3, None)], key=str)
    rng = np.random.default_rng(1)
    values = rng.integers(1, 9, 200).tolist()
    df = spark.createDataFrame(list(enumerate(values)), "id int, v long")
    want, run = {}, 0
    for i, v in sorted(enumerate(values), key=lambda x: (-x[1], x[0])):
        if run < 0.7 * sum(values):
            want[i] = run
        run += v
    assert {r["id"]: r["before"] for r in T.reaching(df, "v", ["id"], 0.7).collect()} == want
    assert T.reaching(df.where("false"), "v", ["id"], 0.7).collect() == []


def test_spacing_without_a_prior(spark):
    c = [spark.createDataFrame([(p, 0.5, 1.0, k + 1) for k, p in enumerate(at)], "pos int, freq double, occupancy double, rank int") for at in ([0, 50], [10, 60], [90])]
    free = A.score_by_prior(*c, None, 5.0, 2.0).collect()
    assert {r["score"] for r in free} == {1.5} and len(free) == 3
    assert {(r["col_1"], r["col_2"]): r["score"] for r in A.score_by_prior(*c, (10, 80), 5.0, 2.0).collect()}[0, 10] == 1.5
