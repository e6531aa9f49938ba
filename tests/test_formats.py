import gzip

import pytest
from pyspark.sql import functions as F

from evidentia.sources import lookup as K
from evidentia.sources import newick, sinks
from evidentia.sources import text as X
from evidentia.streaming import incremental


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_bytes(gzip.compress(text.encode())) if name.endswith(".gz") else p.write_text(text)
    return str(p)


@pytest.mark.parametrize("name", ["a.faa", "a.faa.gz"])
def test_fasta(spark, tmp_path, name):
    path = put(tmp_path, name, ">one first\nACD\n\nEFG\n>two\nHI\n")
    rows = {r["header"]: r["seq"] for r in X.fasta(spark, path).collect()}
    assert rows == {"one first": "ACDEFG", "two": "HI"}
    assert [r["seq_id"] for r in X.fasta_headers(spark, path).collect()] == ["one", "two"]
    assert X.probe(spark, path) == "ok"


def test_probe(spark, tmp_path):
    assert X.probe(spark, put(tmp_path, "d.fna", ">a\nACGTACGTAC\n")) == "looks_like_dna"
    assert X.probe(spark, put(tmp_path, "n.txt", "hello\n")) == "not_fasta"
    assert X.probe(spark, put(tmp_path, "e.faa", "")) == "empty"
    assert X.probe(spark, str(tmp_path / "none.faa")) == "missing"


def test_stockholm(spark, tmp_path):
    path = put(tmp_path, "a.sto", "# STOCKHOLM 1.0\n\nb ACD\na A-D\n#=GC RF xx.\n\nb EF\na E-\n#=GC RF xx\n//\n")
    rows, rf = X.stockholm(spark, path)
    assert [tuple(r) for r in rows.orderBy("ord").collect()] == [("b", 0, "ACDEF"), ("a", 1, "A-DE-")]
    assert rf.first()["rf"] == "xx.xx"


@pytest.fixture
def fine_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def test_formats_over_splits(spark, tmp_path, fine_splits):
    """One file in many splits: line order, blocks, hit tables, later features and profiles."""
    n = 200
    first, second = [f"s{(7 * i) % n} A{i % 10}-" for i in range(n)], [f"s{(7 * i) % n} {'XY'[i % 2]}" for i in range(n)]
    path = put(tmp_path, "b.sto", "# STOCKHOLM 1.0\r\n" + "\r\n".join([*first, "#=GC RF xx.", "", *second, "#=GC RF y", "//", ""]))
    lines = X.ordered_lines(spark, path)
    assert lines.rdd.getNumPartitions() > 4
    assert [r["value"] for r in lines.orderBy("ln").collect()][1:-1] == [*first, "#=GC RF xx.", "", *second, "#=GC RF y"]
    rows, rf = X.stockholm(spark, path)
    assert [tuple(r) for r in rows.orderBy("ord").collect()] == [(f"s{(7 * i) % n}", i, f"A{i % 10}-{'XY'[i % 2]}") for i in range(n)]
    assert rf.first()["rf"] == "xx.y"
    hit = "  1 {} some name  99.8 2.1E-24 3.0E-29 150.2 0.0 120 1-120 3-122 (284)\n"
    for f in ("q1", "q2"):
        body = "".join(hit.format(f"{f}t{i}") for i in range(30))
        put(tmp_path, f"{f}.hhr", hit.format("early") + f"Query  {f}\n No Hit\n{body}\n{hit.format('late')}Query  other\n")
    put(tmp_path, "none.hhr", f"Query  none\n{hit.format('x')}")
    got = X.reports(spark, str(tmp_path / "*.hhr")).select("query", "target").collect()
    assert sorted(map(tuple, got)) == sorted((f, f"{f}t{i}") for f in ("q1", "q2") for i in range(30))
    gff = "".join(f"c1\ts\tgene\t{1000 - i}\t{1000 - i}\t.\t+\t.\tID=g{i % 50}\n" for i in range(100))
    assert {r["id"]: r["start"] for r in X.gff3(spark, put(tmp_path, "s.gff", gff)).collect()} == {f"g{i}": 950 - i for i in range(50)}
    hmm = "".join(f"HMMER3/f\nNAME  p{i}\nLENG  {i}\nHMM   A\n 1 2\n//\n" for i in range(60))
    assert {(r["name"], r["length"]) for r in X.profile_headers(spark, put(tmp_path, "s.hmm", hmm)).collect()} == {(f"p{i}", i) for i in range(60)}
    pdb = "".join(f"ATOM  {i:5d}  CA  GLY A{i:4d}    {1:8.3f}{2:8.3f}{3:8.3f}  1.00  0.00           C\n" for i in range(80))
    assert {r["resnum"] for r in X.atoms(spark, put(tmp_path, "s.pdb", pdb), "A").collect()} == set(range(80))


def test_formats_without_rows(spark, tmp_path):
    rows, rf = X.stockholm(spark, put(tmp_path, "e.sto", "# STOCKHOLM 1.0\n//\n"))
    assert rows.count() == 0 and rf.first()["rf"] == ""
    assert X.hhr(spark, put(tmp_path, "e.hhr", "")).count() == 0


def test_match_rows(spark, tmp_path):
    row = "t1 - 100 P - 60 1e-9 55.5 0.1 1 2 1e-8 1e-7 50.2 0.0 1 50 3 60 2 61 0.95"
    path = put(tmp_path, "batch_00012.spec.domtblout", f"# c\n\n{row} prot genome more\n{row}\nshort row\n{row.replace('55.5', 'x')} p g\n")
    rows = X.batches(spark, path)
    assert rows.count() == 3 and {(r["batch"], r["label"]) for r in rows.collect()} == {("00012", "spec")}
    hits = X.typed_hits(rows, "P", 50.0).collect()
    assert {(h["protein_id"], h["sample"]) for h in hits} == {("prot", "genome"), ("t1", None)}
    assert X.scores_only(rows, 60.0).count() == 0


def test_gff_and_headers(spark, tmp_path):
    g = "##gff\nc1\ts\tCDS\t500\t900\t.\t-\t0\tID=cds-P1;locus_tag=L1\nc1\ts\tgene\t10\t90\t.\t+\t.\tID=gene-L2;Name=n2\nc1\ts\texon\t1\t2\t.\t+\t.\tID=x\n"
    got = {r["id"]: (r["contig"], r["start"], r["order"]) for r in X.gff3(spark, put(tmp_path, "a.gff", g)).collect()}
    assert got["P1"] == ("c1", 500, 1) and got["cds-P1"] == got["L1"] == got["P1"] and got["n2"] == ("c1", 10, 0) and "x" not in got
    path = put(tmp_path, "g.faa", ">ctg1_1 # 1 # 90 # 1 # x\nM\n>ctg1_2 # 500 # 900 # -1 # x\nM\n")
    rows, why = X.coordinates(spark, "gene_caller", path, None)
    assert why == "gene headers" and {r["id"]: (r["contig"], r["strand"], r["order"]) for r in rows.collect()}["ctg1_2"] == ("ctg1", "-", 1)
    assert X.coordinates(spark, "other", None, None)[0] is None


def test_hit_tables(spark, tmp_path):
    line = "q\tt1\t0.5\t10\t1\t0\t1\t9\t1\t9\t1e-5\t80\n"
    assert X.structure_hits(spark, put(tmp_path, "f.m8", line + line.replace("1e-5", "bad") + "q\tt\n" + line)).count() == 2
    hhr = "Query         prot1\nMatch 1\n\n No Hit                             Prob E-value P-value  Score    SS Cols Query HMM  Template HMM\n  1 8JX4_A some name here          99.8 2.1E-24 3.0E-29  150.2   0.0  120    1-120     3-122 (284)\n  2 1ABC_B other                   45.1     0.5 1.0E-05   30.0   0.0   40   10-50     20-60  (99)\n\nNo 1\n"
    rows = X.hhr(spark, put(tmp_path, "a.hhr", hhr)).orderBy(F.col("prob").desc()).collect()
    assert [(r["query"], r["target"], r["prob"], r["evalue"]) for r in rows] == [("prot1", "8JX4_A", 99.8, 2.1e-24), ("prot1", "1ABC_B", 45.1, 0.5)]


def test_profile_headers_and_sites(spark, tmp_path):
    path = put(tmp_path, "p.hmm", "HMMER3/f\nNAME  fam\nACC   PF1.2\nLENG  60\nGA    25.5 25.5;\nHMM   A C\n 1 2\n//\nHMMER3/f\nNAME  bare\nLENG  9\nHMM   A\nGA    99\n//\n")
    got = {r["name"]: (r["acc"], r["length"], r["ga"]) for r in X.profile_headers(spark, path).collect()}
    assert got == {"fam": ("PF1.2", 60, 25.5), "bare": (None, 9, None)}
    js = put(tmp_path, "s.json", '{"MLE": {"headers": [["alpha", "d"], ["p", "d"]], "content": {"0": [[0.1, 0.5], [0.2, 0.01]]}}}')
    assert [(r["site"], r["values"]["p"]) for r in X.site_table(spark, js).collect()] == [(0, 0.5), (1, 0.01)]


CIF = """data_x
loop_
_atom_site.group_PDB
_atom_site.type_symbol
_atom_site.auth_atom_id
_atom_site.auth_comp_id
_atom_site.auth_asym_id
_atom_site.auth_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
ATOM C CA GLY A 5 1.0 2.0 3.0
ATOM H H GLY A 5 1.0 2.0 3.0
ATOM C CA GLY B 6 1.0 2.0 3.0
HETATM CA CA CA C 9 4.0 5.0 6.0
"""


def test_atoms(spark, tmp_path):
    rows = X.atoms(spark, put(tmp_path, "s.cif", CIF), "A", ("CA",)).collect()
    assert {(r["chain"], r["resnum"], r["is_ion"]) for r in rows} == {("A", 5, False), ("C", 9, True)}
    pdb = "ATOM      1  CA  GLY A   5       1.000   2.000   3.000  1.00  0.00           C\nHETATM    2 CA    CA C   9       4.000   5.000   6.000  1.00  0.00          CA\n"
    assert {r["resname"] for r in X.atoms(spark, put(tmp_path, "s.pdb", pdb), "A", ("CA",)).collect()} == {"GLY", "CA"}


def test_newick():
    t = newick.edge_table("((A:1,'B c':2)95/80:1,[note](C,s__)x,D:6);")
    assert newick.tip_labels("((A:1,'B c':2)95:1,(C,D)x);") == ["A", "B c", "C", "D"]
    assert t.loc[t.name == "95/80", "support"].iloc[0] == 80
    assert t.loc[t.name == "B c", "branch_length"].iloc[0] == 2
    r = newick.midpoint_root(newick.edge_table("((A:1,B:2):1,D:6);"))
    d = newick.layout(r).set_index("node")["x"]
    tips = r.loc[r.is_tip].set_index("name")["node"]
    assert d[tips["D"]] == pytest.approx(4.5) and d[tips["B"]] == pytest.approx(4.5)
    assert newick.tip_labels("A;") == ["A"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "x" * 130)], "name string, seq string")
    sinks.fasta(df, "name", "seq", str(tmp_path / "f"))
    assert [r["seq"] for r in X.fasta(spark, str(tmp_path / "f")).collect()] == ["x" * 130]
    sinks.tsv(df, str(tmp_path / "t"))
    assert X.tsv(spark, str(tmp_path / "t"), ["name"]).first()["name"] == "a"
    sinks.json_document(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["name"] == "a"
    long = spark.createDataFrame([("r", 1, 0.5)], "r string, c int, v double")
    sinks.matrix(long, "r", "c", "v", [1, 2], str(tmp_path / "m"))
    assert X.tsv(spark, str(tmp_path / "m")).first()["1"] == "0.50"
    sinks.batched(df.withColumn("b", F.lit("00001")), "b", str(tmp_path / "b"))
    assert (tmp_path / "b" / "b=00001").is_dir()
    doc = "".join(sinks.graphml(df.select("name"), spark.createDataFrame([("a", "a", 1.0)], "u string, v string, w double"), ["name"], "w"))
    assert '<edge source="a" target="a">' in doc
    assert "| a |" in sinks.markdown(df, ["name"])


def test_incremental(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "k string, s double, o long"
    spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 2)], schema).write.parquet(src)
    run = lambda f: f(spark.readStream.schema(schema).parquet(src)).awaitTermination()
    best = lambda st: incremental.best_match(st, ["k"], "s", ["o"], str(tmp_path / "best"), str(tmp_path / "c1"))
    run(best)
    spark.createDataFrame([("a", 5.0, 3), ("b", 2.0, 4)], schema).write.mode("append").parquet(src)
    run(best)
    assert {r["k"]: (r["o"], r["n_matches"]) for r in incremental.latest(spark, str(tmp_path / "best")).collect()} == {"a": (3, 2), "b": (2, 2)}
    run(lambda st: incremental.counts(st, ["k"], str(tmp_path / "n"), str(tmp_path / "c2")))
    assert {r["k"]: r["n"] for r in incremental.latest(spark, str(tmp_path / "n")).collect()} == {"a": 2, "b": 2}


def test_lookup_stops_when_all_is_found():
    seen = []

    def lines():
        for x in (">a one", "AC", "D", "", ">b", ">a again", "KK", ">c", "EE F", ">d", "GG"):
            seen.append(x)
            yield x + "\n"

    assert list(K.found(lines(), {"a", "b"})) == [("a", "a one", "ACD", 1), ("b", "b", "", 2)] and seen[-1] == ">a again"
    assert list(K.found(lines(), {"c", "no"})) == [("c", "c", "EEF", 4)] and list(K.found(lines(), set())) == []
    assert list(K.found(lines(), {"d"})) == [("d", "d", "GG", 5)]


def test_lookup(spark, tmp_path):
    one = put(tmp_path, "one.faa", ">a first\nACD\nEF\n>b\nGH\n>c\nIK\n")
    # what stands beyond the last wanted record can't even be unpacked
    whole = gzip.compress("".join(f">x{i}\n{'AC' * (i % 50)}\n" for i in range(50_000)).encode())
    two = str(tmp_path / "two.faa.gz")
    with open(two, "wb") as f:
        f.write(whole[: len(whole) // 2])
    rows = [(one, "a"), (one, "c"), (one, "c"), (two, "x7"), (two, "x9"), (one, "absent"), (None, "a"), (one, None)]
    wanted = spark.createDataFrame(rows, "path string, seq_id string")
    got = K.lookup(wanted.where("seq_id != 'absent'"))
    assert {(r["path"], r["seq_id"], r["header"], r["seq"], r["records_read"]) for r in got.collect()} == {(one, "a", "a first", "ACDEF", 1), (one, "c", "c", "IK", 3), (two, "x7", "x7", "AC" * 7, 8), (two, "x9", "x9", "AC" * 9, 10)}
    only = wanted.where("path like '%one%' and seq_id is not null")
    assert [tuple(r) for r in K.missing(only, K.lookup(only)).collect()] == [(one, 1)]
    assert K.lookup(wanted.where("false")).collect() == []
    with pytest.raises(ValueError):
        K.WANTED_BYTES, was = 3, K.WANTED_BYTES
        try:
            K.lookup(wanted)
        finally:
            K.WANTED_BYTES = was


def test_lookup_pushes_filters(spark, tmp_path):
    one = put(tmp_path, "one.faa", ">a\nAC\n>b\nGH\n")
    asked = '[["%s", ["a", "b"]], ["%s", ["a"]]]' % (one, tmp_path / "gone.faa")
    spark.dataSource.register(K.FastaLookup)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("fasta_lookup").option("wanted", asked).option("pushdown", "true").load()
        # the other file is not there, and is not opened as nothing is asked of it
        assert [(r["seq_id"], r["records_read"]) for r in df.where("seq_id = 'b'").collect()] == [("b", 2)]
        assert [r["seq"] for r in df.where(F.col("path") == one).where(F.col("seq_id").isin("a", "z")).collect()] == ["AC"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_once_writes_what_is_not_whole(spark, tmp_path):
    path, df = str(tmp_path / "out"), spark.range(3)
    write = lambda d, at: sinks.tsv(d, at)
    assert sinks.finished(spark, path) is None and sinks.once(df, path, "a", write) and sinks.finished(spark, path) == "a"
    assert not sinks.once(spark.range(9), path, "a", write) and X.tsv(spark, path).count() == 3
    assert sinks.once(spark.range(9), path, "b", write) and X.tsv(spark, path).count() == 9 and sinks.finished(spark, path) == "b"

    def breaks(d, at):
        write(d, at)
        raise OSError("disk")

    with pytest.raises(OSError):
        sinks.once(df, path, "c", breaks)
    assert sinks.finished(spark, path) is None and sinks.once(df, path, "c", write) and X.tsv(spark, path).count() == 3
