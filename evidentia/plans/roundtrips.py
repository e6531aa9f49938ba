"""Every reader and sink over whole tables: rows are spelled in a format, written to the shared
folder, read back and compared; and the scalars, joins and checks that no other query runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import entities as E
from ..operators import evidence as V
from ..operators import guards as G
from ..operators import joins as J
from ..operators import sequences as Q
from ..operators.reference_data import values
from ..operators.staging import folder, numbered
from ..sources import newick, sinks
from ..sources import text as X
from ..sources.lookup import lookup
from .genomics import _CODON, NT_SQL, nucleotides
from .registry import query, table


def place(spark, kind: str) -> str:
    return f"{folder(spark)}/{kind}-{uuid.uuid4().hex}"


def written(lines: DataFrame, kind: str, order: str | None = None) -> str:
    """The path of a folder of text files with ``lines`` (one string column first); one file,
    in order, where ``order`` names a column, for formats in which a file is one record."""
    path = place(lines.sparkSession, kind)
    if order:
        lines = lines.coalesce(1).sortWithinPartitions(order)
    lines.select(lines.columns[0]).write.text(path)
    return path


def line(fmt: str, *columns) -> F.Column:
    return F.format_string(fmt, *[F.col(c) if isinstance(c, str) else c for c in columns])


def texts(spark, rows: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "o long, line string").select("line", F.col("o").cast("double").alias("o"))


# --- readers -------------------------------------------------------------------------------------


@query("SELECT replace(n_name, ' ', '_') AS seq_id, row_number() OVER (ORDER BY n_nationkey) - 1 AS ord, 'AC' || n_nationkey % 7 || '-EF' || n_regionkey AS aligned, 'xxx.xx.' AS rf FROM nation")
def stockholm_roundtrip(spark, sf_dir):
    """Two blocks of one alignment of all nations, with a reference line for each."""
    n = table(spark, sf_dir, "nation").withColumn("id", F.replace("n_name", F.lit(" "), F.lit("_")))
    one = n.select(line("%s  AC%s-", "id", F.col("n_nationkey") % 7).alias("line"), (F.col("n_nationkey") + 10.0).alias("o"))
    two = n.select(line("%s  EF%s", "id", "n_regionkey").alias("line"), (F.col("n_nationkey") + 100010.0).alias("o"))
    fixed = values(spark, [("# STOCKHOLM 1.0", 0.0), ("", 1.0), ("#=GC RF xxx.", 100000.0), ("", 100001.0), ("#=GC RF xx.", 1e9), ("//", 2e9)], "line", "o").select("line", F.col("o").cast("double").alias("o"))
    rows, rf = X.stockholm(spark, written(fixed.unionByName(one).unionByName(two), "sto", "o"))
    return rows.crossJoin(F.broadcast(rf))


@query("SELECT 'c' || c_custkey AS seq_id, row_number() OVER (ORDER BY c_custkey) - 1 AS ord, 'AC' || c_custkey % 7 || '-EF' || c_nationkey AS aligned, 'xxx.xx.' AS rf FROM customer")
def stockholm_parts(spark, sf_dir):
    """Two blocks of one alignment of all customers, written by many tasks as parts in order and read by many."""
    c = table(spark, sf_dir, "customer").withColumn("o", F.col("c_custkey").cast("double"))
    last = 1e15
    one = c.select(line("c%s  AC%s-", "c_custkey", F.col("c_custkey") % 7).alias("line"), "o")
    two = c.select(line("c%s  EF%s", "c_custkey", "c_nationkey").alias("line"), (F.col("o") + 2 * last).alias("o"))
    fixed = values(spark, [("# STOCKHOLM 1.0", -2.0), ("", -1.0), ("#=GC RF xxx.", last), ("", 1.5 * last), ("#=GC RF xx.", 4 * last), ("//", 5 * last)], "line", "o").select("line", F.col("o").cast("double").alias("o"))
    path = place(spark, "parts")
    fixed.unionByName(one).unionByName(two).repartitionByRange(32, "o").sortWithinPartitions("o").select("line").write.text(path)
    rows, rf = X.stockholm(spark, path)
    return rows.crossJoin(F.broadcast(rf))


@query("SELECT 'q' || p_size AS query, 'P' || p_partkey AS target, (p_partkey % 100 + 0.5)::DOUBLE AS prob, 2e-5::DOUBLE AS evalue, 7.25::DOUBLE AS score FROM part")
def hit_reports(spark, sf_dir):
    """All parts as hits in a search report for each size, a file each, with rows outside the hit table that aren't hits."""
    p = table(spark, sf_dir, "part")
    hit = lambda target: line("%3d %s some name (x)   %.1f 2E-5 3.0E-09 7.25 0.0 120 1-120 3-122 (284)", F.lit(1), target, F.col("p_partkey") % 100 + F.lit(0.5))
    rows = p.select(hit(line("P%s", "p_partkey")).alias("line"), "p_size", F.col("p_partkey").cast("double").alias("o"))
    around = [(F.lit("  1 early 99.8 2.1E-24 3.0E-29 150.2 0.0 120 1-120 3-122 (284)"), -3.0), (line("Query         q%s", "p_size"), -2.0), (F.lit(" No Hit                             Prob"), -1.0), (F.lit(""), 1e15), (F.lit("  1 late 99.8 2.1E-24 3.0E-29 150.2 0.0 120 1-120 3-122 (284)"), 2e15)]
    sizes = p.select("p_size").distinct()
    for text, o in around:
        rows = rows.unionByName(sizes.select(text.alias("line"), "p_size", F.lit(o).alias("o")))
    path = place(spark, "reports")
    rows.repartition("p_size").sortWithinPartitions("p_size", "o").select("line", "p_size").write.partitionBy("p_size").text(path)
    return X.hhr(spark, path)


@query("SELECT 'd' || doc_id AS seq_id, 'd' || doc_id || ' from ' || coalesce(source, '') AS header FROM documents")
def fasta_headers_roundtrip(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(" from "), F.coalesce("source", F.lit(""))).alias("name"), F.lit("ACD").alias("s"))
    path = place(spark, "fasta")
    sinks.fasta(d, "name", "s", path)
    return X.fasta_headers(spark, path).select("seq_id", "header")


@query("""SELECT 1 AS attempt, 'meta' AS mode, true AS wrote, count(*) AS n FROM supplier UNION ALL SELECT 2, 'meta', false, count(*) FROM supplier UNION ALL SELECT 3, 'single', true, count(*) FILTER (s_acctbal > 0) FROM supplier
UNION ALL SELECT 4, 'single', false, count(*) FILTER (s_acctbal > 0) FROM supplier""")
def marked_write(spark, sf_dir):
    """A table written in a mode, asked for again, then in another mode."""
    path, s = place(spark, "marked"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    rows = None
    for k, mode in enumerate(["meta", "meta", "single", "single"], 1):
        wrote = sinks.once(s if mode == "meta" else s.where("s_acctbal > 0"), path, mode, lambda df, at: sinks.tsv(df, at))
        n = X.tsv(spark, path).agg(F.count("*").alias("n")).first()["n"]
        one = values(spark, [(k, sinks.finished(spark, path), wrote, n)], "attempt", "mode", "wrote", "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (p_size > 40) AS large, count(*) FILTER (p_size > 40 AND p_retailprice > 0) AS dear, count(*) FILTER (p_size > 900) AS huge FROM part)
SELECT 'dear' AS name, dear AS n_rows, CASE WHEN dear = 0 THEN 'no row left after: size' END AS reason FROM c UNION ALL SELECT 'huge', 0, 'no row left after: size' FROM c WHERE huge = 0 UNION ALL SELECT 'late', 0, 'no row left after: brand' FROM c""")
def empty_reasons(spark, sf_dir):
    """Results with what left them empty."""
    p = table(spark, sf_dir, "part")
    large, huge = p.where("p_size > 40"), p.where("p_size > 900")
    dear = G.why_empty("dear", [("input", p), ("size", large), ("price", large.where("p_retailprice > 0"))])
    none = G.why_empty("huge", [("input", p), ("size", huge), ("price", huge.where("p_retailprice > 1000"))])
    late = G.why_empty("late", [("input", p), ("size", large), ("brand", large.where("p_brand = 'none'"))])
    return dear.unionByName(none).unionByName(late)


@query("""WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE source IS NOT NULL)
SELECT source, 'd' || doc_id AS seq_id, 'ACD' || repeat('K', (doc_id % 90)::INT) AS seq, k AS records_read, n AS records FROM d WHERE 2 * k <= n AND doc_id % 3 = 0""")
def early_lookup(spark, sf_dir):
    """A file for each source, its documents by id; some of the first half of each are asked for, and no file is read
    further than the last of them."""
    d = table(spark, sf_dir, "documents").where("source is not null").select("doc_id", "source")
    seq = F.concat(F.lit("ACD"), F.repeat(F.lit("K"), (F.col("doc_id") % 90).cast("int")))
    record = F.concat(F.lit(">d"), F.col("doc_id").cast("string"), F.lit(" of "), F.col("source"), F.lit("\n"), F.substring(seq, F.lit(1), F.lit(50)), F.when(F.length(seq) > 50, F.concat(F.lit("\n"), F.substring(seq, F.lit(51), F.lit(90)))).otherwise(""))
    path = place(spark, "lookup")
    files = d.select("doc_id", "source", record.alias("value")).repartition("source").sortWithinPartitions("source", "doc_id")
    files.select("value", "source").write.partitionBy("source").text(path)
    # where each is: the files' own headers, met by id
    heads = X.fasta_headers(spark, path, files=True).select("seq_id", "path")
    per = d.groupBy("source").agg(F.count("*").alias("records"))
    ranked = numbered(d, [F.col("source"), F.col("doc_id")], "at")
    first = ranked.groupBy("source").agg(F.min("at").alias("_first"))
    half = ranked.join(first, "source").join(per, "source").where((2 * (F.col("at") - F.col("_first") + 1) <= F.col("records")) & (F.col("doc_id") % 3 == 0))
    asked = half.select("source", "records", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("seq_id")).join(heads, "seq_id")
    return asked.join(lookup(asked), ["path", "seq_id"]).select("source", "seq_id", "seq", "records_read", "records")


@query("SELECT l_returnflag AS label, lpad((ascii(l_returnflag))::VARCHAR, 5, '0') AS batch, l_linenumber::INT AS query_no, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY ALL")
def match_batches(spark, sf_dir):
    """Match rows in files whose names carry batch and label."""
    li = table(spark, sf_dir, "lineitem")
    word = lambda c: F.col(c).cast("string")
    fields = [word("l_orderkey"), F.lit("-"), F.lit("100"), word("l_linenumber"), *map(F.lit, ("-", "60", "1e-9")), word("l_quantity"), *map(F.lit, ("0.1", "1", "7", "1e-8", "1e-7")), word("l_quantity"), *map(F.lit, ("0.0", "1", "50", "3", "60", "2", "61", "0.9"))]
    path = place(spark, "batches")
    li.select("l_returnflag", F.concat_ws(" ", *fields).alias("value")).write.partitionBy("l_returnflag").text(path)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for flag in (x for x in fs.listStatus(Path(path)) if x.isDirectory()):
        label = flag.getPath().getName().split("=")[1]
        for i, f in enumerate(x for x in fs.listStatus(flag.getPath()) if x.getPath().getName().startswith("part")):
            fs.rename(f.getPath(), Path(f"{path}/batch_{ord(label):05d}.{label}.{i}.txt"))
    rows = X.batches(spark, f"{path}/*.txt")
    return rows.groupBy("label", "batch", F.col("query").cast("int").alias("query_no")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("dom_score").cast("double")), 2).alias("total"))


@query("SELECT round(l_quantity, 3) AS score, count(*) AS n FROM lineitem WHERE l_quantity >= 25 GROUP BY ALL")
def score_column(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("float").alias("dom_score"), F.col("l_quantity").cast("float").alias("full_score"))
    return X.scores_only(li, 25.0).groupBy(F.round("score", 3).alias("score")).agg(F.count("*").alias("n"))


@query("SELECT 'q' || l_suppkey AS query, 't' || l_partkey AS target, count(*) AS n, sum(l_linenumber)::BIGINT AS length, round(sum(l_quantity), 2) AS bits FROM lineitem GROUP BY ALL")
def m8_roundtrip(spark, sf_dir):
    s = lambda c: F.col(c).cast("string")
    li = table(spark, sf_dir, "lineitem")
    f = [F.concat(F.lit("q"), s("l_suppkey")), F.concat(F.lit("t"), s("l_partkey")), F.lit("0.5"), s("l_linenumber"), *map(F.lit, "101919"), F.lit("1e-5"), s("l_quantity"), F.lit("100"), F.lit("90")]
    rows = X.m8(spark, written(li.select(F.concat_ws("\t", *f).alias("line")), "m8"))
    return rows.groupBy("query", "target").agg(F.count("*").alias("n"), F.sum("length").alias("length"), F.round(F.sum("bitscore"), 2).alias("bits"))


@query("SELECT lpad(c_custkey::VARCHAR, 9, '0') AS id, c_name AS name FROM customer")
def tsv_roundtrip(spark, sf_dir):
    """Ids with leading zeros survive; only the columns asked for are read."""
    path = place(spark, "tsv")
    sinks.tsv(table(spark, sf_dir, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("id"), "c_acctbal", F.col("c_name").alias("name")), path)
    return X.tsv(spark, path, ["id", "name"])


@query("SELECT 'q' || l_suppkey AS query, count(*) AS n, round(max(l_quantity), 2) AS best FROM lineitem WHERE l_linenumber NOT IN (3, 5) GROUP BY ALL")
def structure_hits_roundtrip(spark, sf_dir):
    """Rows with an unreadable number or too few fields go."""
    s = lambda c: F.col(c).cast("string")
    e = F.when(F.col("l_linenumber") == 3, "bad").otherwise("1e-5")
    f = [F.concat(F.lit("q"), s("l_suppkey")), F.lit("t"), F.lit("0.5"), *map(F.lit, "1019191"), e, s("l_quantity")]
    whole = F.when(F.col("l_linenumber") == 5, F.concat_ws("\t", *f[:6])).otherwise(F.concat_ws("\t", *f))
    rows = X.structure_hits(spark, written(table(spark, sf_dir, "lineitem").select(whole.alias("line")), "hits"))
    return rows.groupBy("query").agg(F.count("*").alias("n"), F.round(F.max("bits"), 2).alias("best"))


@query("SELECT 'prot1' AS query, 'S' || s_suppkey AS target, (s_suppkey % 100 + 0.5)::DOUBLE AS prob, 2e-5::DOUBLE AS evalue, (s_nationkey + 0.25)::DOUBLE AS score FROM supplier")
def hhr_roundtrip(spark, sf_dir):
    """One report with all suppliers as its hit table; what follows a blank line is not read."""
    hit = table(spark, sf_dir, "supplier").select(line("%3d S%s some name (x)   %.1f 2E-5 3.0E-09 %.2f 0.0 120 1-120 3-122 (284)", F.col("s_suppkey") + 1, "s_suppkey", F.col("s_suppkey") % 100 + F.lit(0.5), F.col("s_nationkey") + F.lit(0.25)).alias("line"), (F.col("s_suppkey") + 10.0).alias("o"))
    head = texts(spark, ["Query         prot1", "Match 1", "", " No Hit                             Prob E-value P-value  Score    SS Cols Query HMM  Template HMM"])
    tail = texts(spark, ["", "  1 X not a hit          99.8 2.1E-24 3.0E-29  150.2   0.0  120    1-120     3-122 (284)"]).withColumn("o", F.col("o") + 1e12)
    return X.hhr(spark, written(head.unionByName(hit).unionByName(tail), "hhr", "o"))


GENE_SQL = "g AS (SELECT *, 'c' || o_custkey AS contig, o_orderkey * 100 + 1 AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders WHERE o_orderkey % 5 <> 0)"


@query(f"""WITH {GENE_SQL} SELECT unnest(['cds-P' || o_orderkey, 'P' || o_orderkey, 'L' || o_orderkey]) AS id, contig, a::INT AS start, (a + 89)::INT AS "end", CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, k::INT AS "order" FROM g""")
def gff3_roundtrip(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderkey") % 5 == 0, "exon").otherwise(F.when(F.col("o_orderkey") % 2 == 0, "CDS").otherwise("gene"))
    a = F.col("o_orderkey") * 100 + 1
    text = line("c%s\ts\t%s\t%s\t%s\t.\t%s\t0\tID=cds-P%s;locus_tag=L%s", "o_custkey", kind, a, a + 89, F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-"), "o_orderkey", "o_orderkey")
    rows, _ = X.coordinates(spark, "other", None, written(o.select(text.alias("line")), "gff"))
    return rows


@query("""SELECT 'c' || o_custkey || '_' || o_orderkey AS id, 'c' || o_custkey AS contig, (o_orderkey * 100 + 1)::INT AS start, (o_orderkey * 100 + 90)::INT AS "end", CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS "order" FROM orders""")
def gene_headers_roundtrip(spark, sf_dir):
    a = F.col("o_orderkey") * 100 + 1
    head = line(">c%s_%s # %s # %s # %s # ID=x", "o_custkey", "o_orderkey", a, a + 89, F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1))
    path = written(table(spark, sf_dir, "orders").select(F.concat(head, F.lit("\nMKV")).alias("line")), "genes")
    rows, _ = X.coordinates(spark, "gene_caller", path, None)
    return rows


@query("SELECT 'p' || p_partkey AS name, 'A' || p_partkey || '.1' AS acc, p_size::INT AS length, CASE WHEN p_partkey % 3 <> 0 THEN (p_size + 0.5)::DOUBLE END AS ga, CASE WHEN p_partkey % 2 = 0 THEN (p_size + 0.25)::DOUBLE END AS nc, NULL::DOUBLE AS tc FROM part")
def profile_headers_roundtrip(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    ga = F.when(F.col("p_partkey") % 3 != 0, line("GA    %.1f %.1f;\n", F.col("p_size") + F.lit(0.5), F.col("p_size") + F.lit(0.5))).otherwise("")
    nc = F.when(F.col("p_partkey") % 2 == 0, line("NC    %.2f;\n", F.col("p_size") + F.lit(0.25))).otherwise("")
    one = F.concat(line("HMMER3/f\nNAME  p%s\nACC   A%s.1\nLENG  %s\n", "p_partkey", "p_partkey", "p_size"), ga, nc, F.lit("HMM   A C\nTC    99\n//"))
    return X.profile_headers(spark, written(p.select(one.alias("line")), "hmm")).drop("path")


@query("SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS site, (n_nationkey / 4.0)::DOUBLE AS alpha, (n_regionkey / 8.0)::DOUBLE AS p FROM nation")
def site_table_roundtrip(spark, sf_dir):
    n = table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_nationkey", "n_regionkey").collect()  # one document of 25 rows
    body = ", ".join(f"[{r[0] / 4}, {r[1] / 8}]" for r in n)
    path = written(texts(spark, [f'{{"MLE": {{"headers": [["alpha", "d"], ["p", "d"]], "content": {{"0": [{body}]}}}}}}']), "json", "o")
    rows = X.site_table(spark, path)
    return rows.select("site", rows["values"]["alpha"].alias("alpha"), rows["values"]["p"].alias("p"))


@query("""SELECT CASE WHEN s_suppkey % 7 = 0 THEN 'C' ELSE 'A' END AS chain, (s_suppkey % 9999)::INT AS resnum, CASE WHEN s_suppkey % 7 = 0 THEN 'CA' ELSE 'GLY' END AS resname, 'CA' AS atom, s_nationkey::DOUBLE AS x, 2.0::DOUBLE AS y, 3.5::DOUBLE AS z, s_suppkey % 7 = 0 AS is_ion
FROM supplier WHERE s_suppkey % 7 = 0 OR (s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0)""")
def pdb_roundtrip(spark, sf_dir):
    """Chain A without its hydrogens, and ions of any chain, of one structure of all suppliers."""
    k = F.col("s_suppkey")
    ion, other = k % 7 == 0, k % 3 == 0
    text = line("%-6s%5d %-4s %3s %s%4d    %8.3f%8.3f%8.3f  1.00  0.00          %2s", F.when(ion, "HETATM").otherwise("ATOM"), k % 9999, F.lit(" CA"), F.when(ion, " CA").otherwise("GLY"), F.when(ion, "C").when(other, "B").otherwise("A"), k % 9999, F.col("s_nationkey").cast("double"), F.lit(2.0), F.lit(3.5), F.when(ion, "CA").when(k % 5 == 0, " H").otherwise(" C"))
    return X.atoms(spark, written(table(spark, sf_dir, "supplier").select(text.alias("line"), k.cast("double").alias("o")), "pdb", "o"), "A", ("CA",))


@query("SELECT * FROM (VALUES ('protein', 'ok'), ('dna', 'looks_like_dna'), ('table', 'not_fasta'), ('none', 'missing')) t(file, status)")
def probe_report(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    paths = {"protein": written(n.select(line(">n%s\nMKVLHEW", "n_nationkey").alias("line")), "faa"), "dna": written(n.select(line(">n%s\nACGTACGT", "n_nationkey").alias("line")), "fna"), "table": written(n.select("n_name"), "txt"), "none": place(spark, "none")}
    return values(spark, [(k, X.probe(spark, p)) for k, p in paths.items()], "file", "status")


@query("""SELECT 'n' || n_nationkey AS name, 'r' || n_regionkey AS parent, (1.0 + n_nationkey % 3)::DOUBLE AS branch_length, true AS is_tip, NULL::DOUBLE AS support FROM nation
UNION ALL SELECT DISTINCT 'r' || n_regionkey, 'root', 2.0::DOUBLE, false, NULL FROM nation UNION ALL SELECT 'root', NULL, NULL, false, NULL""")
def newick_roundtrip(spark, sf_dir):
    """The tree of nations as text and as rows again (a tree's text is one record)."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect()
    inside = {}
    for k, r in sorted(map(tuple, n)):
        inside.setdefault(r, []).append(f"n{k}:{1 + k % 3}")
    t = newick.edge_table("(" + ",".join(f"({','.join(v)})r{r}:2" for r, v in sorted(inside.items())) + ")root;")
    names = dict(zip(t["node"], t["name"], strict=True))
    num = lambda x: None if x != x or x is None else float(x)
    rows = [(x["name"], names.get(x["parent"]), num(x["branch_length"]), bool(x["is_tip"]), num(x["support"])) for x in t.to_dict("records")]
    return spark.createDataFrame(rows, "name string, parent string, branch_length double, is_tip boolean, support double")


# --- sinks ---------------------------------------------------------------------------------------


@query("SELECT lpad((o_orderkey // 1000)::VARCHAR, 5, '0') AS batch, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def batch_files(spark, sf_dir):
    path = place(spark, "batched")
    sinks.batched(E.batches(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1000), "batch", path)
    read = spark.read.schema("o_orderkey long, o_totalprice double, batch string").csv(path, sep="\t", header=True)
    return read.groupBy("batch").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def json_document_roundtrip(spark, sf_dir):
    path = place(spark, "doc")
    sinks.json_document(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path)
    return spark.read.schema("n_nationkey long, n_name string").json(path)


@query("SELECT l_returnflag AS flag, printf('%.2f', (count(*) FILTER (l_linenumber = 1)) / 4) AS one, printf('%.2f', (count(*) FILTER (l_linenumber = 2)) / 4) AS two, NULL::VARCHAR AS none FROM lineitem GROUP BY ALL")
def matrix_file(spark, sf_dir):
    """A dense matrix with a column that no row fills."""
    path = place(spark, "matrix")
    long = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), "l_linenumber").agg((F.count("*") / 4).alias("v"))
    sinks.matrix(long, "flag", "l_linenumber", "v", [1, 2, 99], path)
    return X.tsv(spark, path).toDF("flag", "one", "two", "none")


@query("""SELECT '<node id="' || n_nationkey || '"><data key="name">' || replace(n_name, '&', '&amp;') || '</data></node>' AS line FROM nation UNION ALL
SELECT '<edge source="' || a.n_nationkey || '" target="' || b.n_nationkey || '"><data key="w">1.0</data></edge>' FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
def graphml_lines(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a, b = n.select("n_regionkey", F.col("n_nationkey").alias("u")), n.select("n_regionkey", F.col("n_nationkey").alias("v"))
    edges = a.join(b, "n_regionkey").where("u < v").select("u", "v", F.lit(1.0).alias("w"))
    lines = sinks.graphml(n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), edges, ["name"], "w")
    return texts(spark, [x for x in lines if x.startswith(("<node", "<edge"))]).select("line")


@query("SELECT '| ' || r_regionkey || ' | ' || r_name || ' | ' || printf('%.3f', r_regionkey / 4) || ' |' AS line FROM region UNION ALL SELECT unnest(['| k | name | v |', '|---|---|---|'])")
def markdown_table(spark, sf_dir):
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"), (F.col("r_regionkey") / 4).alias("v"))
    return texts(spark, sinks.markdown(r).split("\n")).select("line")


# --- scalars, joins, checks ----------------------------------------------------------------------


@query("""SELECT p_partkey AS id, 'p' || p_partkey AS stem, '/d/p' || p_partkey || '.gff' AS sister, CASE WHEN p_partkey % 2 = 0 THEN p_size::DOUBLE END AS support, round(CASE WHEN p_size > 10 THEN log10(p_size) ELSE 300 END, 6) AS minus_log FROM part""")
def path_scalars(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    path = lambda suffix: line("/d/p%s." + suffix, "p_partkey")
    stem = F.when(F.col("p_partkey") % 3 == 0, S.file_stem(path("fna.gz"))).when(F.col("p_partkey") % 3 == 1, S.file_stem(path("fa"))).otherwise(S.file_stem(path("fasta")))
    label = F.when(F.col("p_partkey") % 2 == 0, line("x/%s", "p_size")).otherwise("0.9/none")
    return p.select(F.col("p_partkey").alias("id"), stem.alias("stem"), S.sister_path(path("faa")).alias("sister"), S.support_value(label).alias("support"), F.round(S.minus_log10(F.when(F.col("p_size") > 10, 1 / F.col("p_size")).otherwise(0.0)), 6).alias("minus_log"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN 'no binding region, so its pH does not matter' WHEN abs(p_size / 4 - 7) < 1 THEN 'pI ' || printf('%.1f', p_size / 4) || ': near the assay pH of 7.0; look at aggregation before reading a negative'
ELSE 'pI ' || printf('%.1f', p_size / 4) || ': test binding near that pH; a negative at the assay pH may be one of binding' END AS advice FROM part WHERE p_size % 2 = 0""")
def ph_advice(spark, sf_dir):
    """Even sizes only, as quarters round in two ways."""
    pi = F.when(F.col("p_partkey") % 9 != 0, F.col("p_size") / 4)
    return table(spark, sf_dir, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("id"), S.ph_advice(pi).alias("advice"))


@query(f"""WITH {NT_SQL}, k AS (SELECT id, i, substr(replace(nt, 'U', 'T'), i * 3 + 1, 3) AS c FROM (SELECT id, nt, unnest(range(0, length(nt) // 3)) AS i FROM nt)), p AS (SELECT id, rtrim(string_agg({_CODON}, '' ORDER BY i), '*') AS p FROM k GROUP BY id)
SELECT nt.id, CASE WHEN nt.id % 4 = 1 THEN 'no_cds' WHEN contains(coalesce(p, ''), '*') THEN 'internal_stop' WHEN nt.id % 4 = 2 THEN 'mismatch' ELSE 'ok' END AS status FROM nt LEFT JOIN p ON p.id = nt.id""")
def cds_status(spark, sf_dir):
    nt = nucleotides(spark, sf_dir)
    cds = F.when(F.col("id") % 4 != 1, F.col("nt"))
    return nt.select("id", Q.cds_status(cds, F.when(F.col("id") % 4 == 2, "QQQ9").otherwise(S.translate_codons(F.col("nt")))).alias("status"))


@query("SELECT 'o_custkey' AS key, count(DISTINCT c_custkey) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def best_overlap(spark, sf_dir):
    """The column of orders that names customers, found by its values."""
    name, n = E.best_overlap_key(table(spark, sf_dir, "customer"), "c_custkey", table(spark, sf_dir, "orders"), ["o_orderpriority", E.resolve_column(["O_CUSTKEY", "x"], ["o_custkey"]).lower(), "o_orderstatus"])
    return values(spark, [(name, n)], "key", "n").withColumn("n", F.col("n").cast("long"))


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1) ON o_custkey = c_custkey")
def left_first(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return J.left_first(table(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey", "o_custkey", [F.col("o_totalprice").desc(), F.col("o_orderkey")])


TIP_SQL = """e AS (SELECT s_suppkey AS k, 'GCA_' || lpad((s_suppkey // 2)::VARCHAR, 9, '0') || '.1' AS sample, 'Genus' || s_nationkey || ' sp' AS species FROM supplier),
t AS (SELECT DISTINCT 'RS_GCF_' || lpad((s_suppkey // 2)::VARCHAR, 9, '0') || '.1' AS tip FROM supplier WHERE s_suppkey % 3 = 0)"""


@query(f"""WITH {TIP_SQL} SELECT k, 'gtdb_accession' AS mode, tip AS tree_tip FROM e LEFT JOIN t ON tip = 'RS_' || replace(sample, 'GCA_', 'GCF_')
UNION ALL SELECT k, 'identity', NULL FROM e UNION ALL SELECT k, 'gtdb_species', CASE WHEN length(species) % 2 = 0 THEN species END FROM e
UNION ALL SELECT k, 'gtdb_species_rep', coalesce(tip, 'RS_' || replace(acc, 'GCA_', 'GCF_')) FROM e LEFT JOIN t ON tip = 'RS_' || replace(sample, 'GCA_', 'GCF_')
 LEFT JOIN (SELECT species AS sp, min(sample) AS acc FROM e WHERE k % 3 = 0 GROUP BY 1) ON sp = species""")
def tip_modes(spark, sf_dir):
    """Four ways from entities to tips: identity (none match), accession variants, species, and the accession of a
    species' representative where one's own has no tip."""
    s = table(spark, sf_dir, "supplier")
    acc = F.concat(F.lit("GCA_"), F.lpad(F.floor(F.col("s_suppkey") / 2).cast("string"), 9, "0"), F.lit(".1"))
    e = s.select(F.col("s_suppkey").alias("k"), acc.alias("sample"), F.concat(F.lit("Genus"), F.col("s_nationkey").cast("string"), F.lit(" sp")).alias("species"))
    tips = e.where("k % 3 = 0").select(F.concat(F.lit("RS_"), F.regexp_replace("sample", "GCA_", "GCF_")).alias("tip"))
    sp = e.where(F.length("species") % 2 == 0).select(F.col("species").alias("tip"))
    out = None
    reps = e.where("k % 3 = 0").select("species", F.col("sample").alias("accession"))
    for mode, names in (("gtdb_accession", tips), ("identity", tips), ("gtdb_species", sp), ("gtdb_species_rep", tips)):
        one = E.resolve_tips(e, names, mode, reps).select("k", F.lit(mode).alias("mode"), "tree_tip")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT count(*) AS n_samples, count(*) FILTER (c_custkey % 3 = 0) AS n_matched, count(DISTINCT c_nationkey) FILTER (c_custkey % 3 = 0) AS n_distinct_tips_used, 25 AS n_tips_in_tree, round((count(*) FILTER (c_custkey % 3 = 0)) / count(*), 6) AS frac_matched FROM customer")
def tip_match_report(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey")).alias("tree_tip"))
    return E.tip_match_report(c, 25, 0.1).drop("genomes_per_tip").withColumn("frac_matched", F.round("frac_matched", 6))


@query("SELECT o_orderkey, o_custkey FROM orders")
def none_missing(spark, sf_dir):
    """Orders pass through the check that each has its customer."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return J.require_none_missing(o, c, ["o_custkey"], "orders").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey AS member, 'r' || n_regionkey AS representative FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey % 2 = 0 UNION ALL SELECT c_custkey, 'n' || n_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey % 2 = 1")
def composed_clusters(spark, sf_dir):
    """Customer to nation to region, where the second step is given for even nations only."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    first = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("member"), name("n", "c_nationkey").alias("representative"))
    second = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(name("n", "n_nationkey").alias("member"), name("r", "n_regionkey").alias("representative"))
    return J.compose_clusters(first, second)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank FROM orders")
def numbered_rows(spark, sf_dir):
    return numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_orderkey", "rank")


@query("SELECT p_partkey AS member, min(p_partkey) OVER (PARTITION BY p_name) AS representative FROM part")
def exact_duplicates(spark, sf_dir):
    return V.exact_duplicates(table(spark, sf_dir, "part"), "p_partkey", "p_name")


@query("SELECT c_custkey, c_nationkey AS cluster, count(*) OVER (PARTITION BY c_nationkey) AS cluster_size, round(1 / count(*) OVER (PARTITION BY c_nationkey), 8) AS weight FROM customer")
def inverse_cluster_weights(spark, sf_dir):
    return V.inverse_cluster_weights(table(spark, sf_dir, "customer"), "c_custkey", F.col("c_nationkey"))


@query("SELECT * FROM (VALUES ('scan', 'ready', 'inputs present'), ('tree', 'waiting', 'newick'), ('figures', 'disabled', 'switched off')) t(stage, status, reason)")
def stage_plan(spark, sf_dir):
    return G.stage_plan(spark, [("scan", True, None), ("tree", True, "newick"), ("figures", False, None)])


@query("""SELECT 'OK' AS level, 'orders: ' || w AS "check", '0 of ' || n || ' rows ' || s AS detail FROM (SELECT count(*) AS n FROM orders), (VALUES ('unique key', 'repeat a key'), ('null key', 'have no key'), ('white space', 'have white space in the key')) t(w, s)""")
def gate(spark, sf_dir):
    """A report without errors passes the gate, strictly."""
    return G.require_ok(G.table_checks(table(spark, sf_dir, "orders"), "o_orderkey", "orders"), strict=True)


@query("SELECT * FROM (VALUES ('by_clade', true), ('by_outcome', false)) t(partition, allowed)")
def partition_guard(spark, sf_dir):
    def allowed(name, defining):
        try:
            G.banned_partition(name, defining, ["col_3", "col_9"])
        except J.CheckFailed:
            return False
        return True

    return values(spark, [(n, allowed(n, d)) for n, d in (("by_clade", ["clade"]), ("by_outcome", ["col_9"]))], "partition", "allowed")


@query("""SELECT CASE WHEN k > 0 THEN 'WARN' ELSE 'OK' END AS level, 'orders: spot check' AS "check", k || ' of ' || n || ' sampled rows fail' AS detail FROM (SELECT count(*) AS n, count(*) FILTER (o_totalprice < 100000) AS k FROM orders)""")
def spot_check(spark, sf_dir):
    """With every row in the sample, so that SQL can say the same."""
    return G.spot_check(table(spark, sf_dir, "orders").withColumn("ok", F.col("o_totalprice") >= 100000), "ok", 1.0, 7, "orders")


@query("""SELECT CASE WHEN ok THEN 'OK' ELSE 'ERROR' END AS level, 'seed: s' || s_suppkey AS "check", CASE WHEN ok THEN 'found by its family''s spacing' ELSE 'its family''s spacing would discard it' END AS detail
FROM (SELECT *, CASE WHEN s_nationkey % 3 = 2 THEN true WHEN s_suppkey % 2 = 0 THEN abs(s_nationkey - CASE WHEN s_nationkey % 3 = 0 THEN 10 ELSE 20 END) <= 4 ELSE least(abs(5 - CASE WHEN s_nationkey % 3 = 0 THEN 10 ELSE 20 END), abs(s_nationkey + 9 - CASE WHEN s_nationkey % 3 = 0 THEN 10 ELSE 20 END)) <= 4 END AS ok FROM supplier)""")
def seed_checks(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    family = F.concat(F.lit("f"), (F.col("s_nationkey") % 3).cast("string"))
    seeds = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("name"), family.alias("family"), F.lit(100).alias("anchor"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey") + 100).alias("next"), F.array(F.lit(5), F.col("s_nationkey") + 9).alias("candidates"))
    return G.seed_checks(seeds, {"f0": 10, "f1": 20, "f2": None}, 4)


@query("SELECT count(*) AS n FROM orders")
def structure_identity(spark, sf_dir):
    """Nine in ten columns agree or more, so the pairs pass."""
    o = table(spark, sf_dir, "orders").select(F.lit("A").alias("structure"), F.when(F.col("o_orderkey") % 20 == 0, "C").otherwise("A").alias("sequence"))
    return G.structure_identity(o).agg(F.count("*").alias("n"))
