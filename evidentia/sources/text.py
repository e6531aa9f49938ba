"""Readers of line- and record-oriented scientific text.

Each reader takes a path (any that Spark reads, gzip by suffix) or, with ``from_lines``, a
table of lines, and returns a typed DataFrame.  Records are split by Spark's text source, so
a file larger than one partition is read in parallel; formats whose lines belong together in
their order (Stockholm, search reports, gene features) sort by the place of a line in its file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.staging import numbered


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(header, seq, path): wrapped rows joined, blank lines skipped."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace(F.regexp_replace("value", "^\\s*>", ""), "\r", "").alias("v"), F.col("_metadata.file_path").alias("path"))
    rec = raw.where(F.trim("v") != "")
    head = F.substring_index("v", "\n", 1)
    return rec.select(F.trim(head).alias("header"), F.regexp_replace(F.expr("substring(v, length(substring_index(v, '\n', 1)) + 1)"), r"\s", "").alias("seq"), "path")


def fasta_headers(spark: SparkSession, path: str, files: bool = False) -> DataFrame:
    """(header, seq_id), with ``files`` the path of the file as well."""
    where = [F.col("_metadata.file_path").alias("path")] if files else []
    return spark.read.text(path).where(F.col("value").startswith(">")).select(F.trim(F.expr("substring(value, 2)")).alias("header"), first_token(F.expr("substring(value, 2)")).alias("seq_id"), *where)


def first_token(header: Column) -> Column:
    return F.get(F.split(F.trim(header), r"\s+"), 0)


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, value, ln): lines of text and an ``ln`` that sorts them as they stand, files by name.

    A large file is read in splits by many tasks.  ``ln`` is the file, where the split begins in it
    and a number that grows within the split, so no line needs to know how many lines are before it; it
    says nothing of distance.  Compressed files are one split.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r$", "").alias("value"), at.alias("ln"))


def stockholm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((seq_id, ord, aligned), one row (rf)): blocks of a name are joined in file order.  The path is
    one alignment, in one file or in a folder of parts that follow each other by name.  Without a
    sequence there are no rows; without a reference line rf is ''."""
    lines = ordered_lines(spark, path)
    body = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "") & (F.trim("value") != "//"))
    part = body.select("ln", F.split(F.trim("value"), r"\s+", 2).alias("p")).select("ln", F.col("p")[0].alias("seq_id"), F.get("p", 1).alias("chunk"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", c))), lambda x: x[c]), "")
    rows = part.groupBy("seq_id").agg(F.min("ln").alias("_at"), joined("chunk").alias("aligned"))
    rf = lines.where(F.col("value").startswith("#=GC RF")).select("ln", F.regexp_replace("value", r"^#=GC RF\s+", "").alias("chunk"))
    return numbered(rows, [F.col("_at")], "ord").select("seq_id", "ord", "aligned"), rf.agg(joined("chunk").alias("rf"))


DOMTBL = [
    ("target", "string"), ("tacc", "string"), ("tlen", "int"), ("query", "string"), ("qacc", "string"), ("qlen", "int"), ("full_evalue", "double"), ("full_score", "float"), ("full_bias", "float"),
    ("dom_idx", "smallint"), ("dom_n", "smallint"), ("c_evalue", "double"), ("i_evalue", "double"), ("dom_score", "float"), ("dom_bias", "float"), ("hmm_from", "int"), ("hmm_to", "int"),
    ("ali_from", "int"), ("ali_to", "int"), ("env_from", "int"), ("env_to", "int"), ("acc", "float"),
]


def match_rows(lines: DataFrame) -> DataFrame:
    """Domain match rows from a column ``value``: comments, blanks and short rows are dropped, 22
    typed fields and the rest as description ('' where missing); unreadable numbers are null."""
    f = F.split(F.trim("value"), r"\s+", 23)
    ok = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("_f", f).where(F.size("_f") >= 22)
    return ok.select(*[c for c in lines.columns if c != "value"], *[F.get("_f", i).try_cast(t).alias(n) for i, (n, t) in enumerate(DOMTBL)], F.coalesce(F.get("_f", 22), F.lit("")).alias("description"))


def matches(spark: SparkSession, path: str) -> DataFrame:
    return match_rows(spark.read.text(path))


def typed_hits(rows: DataFrame, label: str, min_score: float | None = None) -> DataFrame:
    """Hits of one profile: rows with unreadable scores go, a threshold holds for the full and
    the domain score, and provenance comes from the description."""
    ok = rows.where(F.col("full_score").isNotNull() & F.col("dom_score").isNotNull() & F.col("i_evalue").isNotNull())
    if min_score is not None:
        ok = ok.where((F.col("full_score") >= min_score) & (F.col("dom_score") >= min_score))
    d = F.split(F.trim("description"), r"\s+")
    return ok.select(F.lit(label).alias("profile"), F.coalesce(F.nullif(F.get(d, 0), F.lit("")), "target").alias("protein_id"), F.get(d, 1).alias("sample"), *rows.columns)


def scores_only(rows: DataFrame, min_score: float | None = None) -> DataFrame:
    """One score per domain row."""
    s = rows.select(F.col("dom_score").cast("double").alias("score"), "full_score").where("score is not null")
    return (s if min_score is None else s.where((F.col("score") >= min_score) & (F.col("full_score") >= min_score))).select("score")


def batches(spark: SparkSession, glob: str) -> DataFrame:
    """Match rows of many files with the batch and label that their names carry."""
    lines = spark.read.text(glob).select("value", F.regexp_extract("_metadata.file_name", r"batch_(\d+)\.", 1).alias("batch"), F.regexp_extract("_metadata.file_name", r"batch_\d+\.([^.]+)\.", 1).alias("label"))
    return match_rows(lines)


def tsv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Every column a string, so leading zeros survive; only ``columns`` where given."""
    df = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    return df.select(*columns) if columns else df


M8 = "query string, target string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double, qlen int, slen int"


def m8(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=M8)


def structure_hits(spark: SparkSession, path: str) -> DataFrame:
    """Tabular structure search hits: rows of 12 fields or more with readable numbers."""
    f = spark.read.text(path).select(F.split("value", "\t").alias("f")).where("size(f) >= 12")
    out = f.select(F.col("f")[0].alias("query"), F.col("f")[1].alias("target"), F.col("f")[2].try_cast("double").alias("identity"), F.col("f")[10].try_cast("double").alias("evalue"), F.col("f")[11].try_cast("double").alias("bits"))
    return out.where("identity is not null and evalue is not null and bits is not null")


HIT_ROW = r"^\s*\d+\s+(\S+).*?\s(\d+(?:\.\d+)?)\s+([\d.Ee+-]+)\s+([\d.Ee+-]+)\s+([\d.-]+)\s+([\d.-]+)\s+(\d+)\s+\S+\s+\S+\s*\(\d+\)\s*$"


def reports(spark: SparkSession, path: str) -> DataFrame:
    """(path, query, target, prob, evalue, score): the hit tables of profile-profile search reports, a
    report for each file: the lines between the first ``No Hit`` and the blank line after it, with the
    first ``Query`` of the file (null if none).  Files without a hit table have no rows."""
    lines = ordered_lines(spark, path)
    head = F.ltrim("value").startswith("No Hit")
    per = lines.where(head | F.col("value").startswith("Query")).groupBy("path").agg(
        F.min(F.when(head, F.col("ln"))).alias("a"), F.trim(F.min_by(F.when(~head, F.expr("substring(value, 6)")), F.when(~head, F.col("ln")))).alias("query")
    )
    per = per.where("a is not null")
    ends = lines.where("trim(value) = ''").join(per, "path").where("ln > a").groupBy("path").agg(F.min("ln").alias("b"))
    hit = lines.where(F.col("value").rlike(HIT_ROW)).join(per, "path").join(ends, "path", "left").where("ln > a and (b is null or ln < b)")
    g = lambda i: F.regexp_extract("value", HIT_ROW, i)
    return hit.select("path", "query", g(1).alias("target"), g(2).try_cast("double").alias("prob"), g(3).try_cast("double").alias("evalue"), g(5).try_cast("double").alias("score"))


def hhr(spark: SparkSession, path: str) -> DataFrame:
    """``reports`` without the path."""
    return reports(spark, path).drop("path")


def gff3(spark: SparkSession, path: str) -> DataFrame:
    """(id, contig, start, end, strand, order): gene features under every id that they have;
    an id with ``-`` also under what follows it; a later feature replaces an earlier one."""
    f = ordered_lines(spark, path).where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f"), "ln").where("size(f) >= 9")
    f = f.where(F.col("f")[2].isin("CDS", "gene", "mRNA"))
    genes = f.select("ln", F.col("f")[0].alias("contig"), F.col("f")[2].alias("type"), F.col("f")[3].try_cast("int").alias("start"), F.col("f")[4].try_cast("int").alias("end"), F.col("f")[6].alias("strand"), F.col("f")[8].alias("attrs")).where("start is not null and end is not null")
    genes = genes.withColumn("order", F.row_number().over(W.partitionBy("contig").orderBy("start", "ln")) - 1)
    ids = F.array(*[F.nullif(F.regexp_extract("attrs", rf"(?:^|;)\s*{k}=([^;]*)", 1), F.lit("")) for k in ("ID", "locus_tag", "protein_id", "Name", "gene", "old_locus_tag")])
    full = F.array_compact(ids)
    all_ids = F.array_distinct(F.concat(full, F.transform(F.filter(full, lambda x: F.contains(x, F.lit("-"))), lambda x: F.regexp_replace(x, "^[^-]*-", ""))))
    long = genes.select(F.explode(all_ids).alias("id"), "ln", "contig", "start", "end", "strand", "order")
    last = long.groupBy("id").agg(F.max_by(F.struct("contig", "start", "end", "strand", "order"), "ln").alias("x"))
    return last.select("id", "x.*")


def gene_headers(headers: DataFrame) -> DataFrame:
    """(id, contig, start, end, strand, order) from ``id # start # end # strand # …`` headers."""
    p = headers.select(F.split("header", r"\s*#\s*").alias("p")).where("size(p) >= 4")
    g = p.select(first_token(F.col("p")[0]).alias("id"), F.col("p")[1].try_cast("int").alias("start"), F.col("p")[2].try_cast("int").alias("end"), F.when(F.col("p")[3] == "-1", "-").otherwise("+").alias("strand")).where("start is not null")
    g = g.withColumn("contig", F.regexp_replace("id", "_[^_]*$", ""))
    return g.withColumn("order", F.row_number().over(W.partitionBy("contig").orderBy("start", "id")) - 1).select("id", "contig", "start", "end", "strand", "order")


def coordinates(spark: SparkSession, source: str, faa: str | None, gff: str | None) -> tuple[DataFrame | None, str]:
    """Coordinates from where a genome's source has them, or None and why."""
    if source == "gene_caller" and faa:
        return gene_headers(fasta_headers(spark, faa)), "gene headers"
    if gff:
        return gff3(spark, gff), "gff"
    return None, "neither gene headers nor a GFF file"


def profile_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, acc, length, ga, nc, tc) of profile files: a profile ends at ``//``, its header at
    ``HMM ``."""
    whole = spark.read.option("lineSep", "\n//").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("v")).where(r"v rlike '\\S'")
    head = F.get(F.split("v", r"(?m)^HMM\s"), 0)
    field = lambda k: F.nullif(F.regexp_extract(head, rf"(?m)^{k}\s+(\S+)", 1), F.lit(""))
    number = lambda k: F.regexp_replace(field(k), ";$", "").try_cast("double")
    return whole.select("path", field("NAME").alias("name"), field("ACC").alias("acc"), field("LENG").try_cast("int").alias("length"), number("GA").alias("ga"), number("NC").alias("nc"), number("TC").alias("tc"))


def site_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows of per-site results: ``MLE.content.0`` with the names in ``MLE.headers``."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "MLE struct<headers:array<array<string>>,content:map<string,array<array<double>>>>").alias("j"))
    rows = doc.select(F.transform("j.MLE.headers", lambda h: h[0]).alias("names"), F.posexplode(F.try_element_at("j.MLE.content", F.lit("0"))).alias("site", "v"))
    return rows.select("site", F.map_from_arrays("names", F.slice("v", F.lit(1), F.size("names"))).alias("values"))


PROBE_BASES = "ACGTUN"


def probe(spark: SparkSession, path: str, n: int = 50) -> str:
    """ok / empty / unreadable / not_fasta / looks_like_dna of a sequence file's first lines."""
    try:
        lines = [r["value"] for r in spark.read.text(path).limit(n).collect()]
    except Exception as e:  # what a reader can't open is reported, not raised
        return "missing" if "PATH_NOT_FOUND" in str(e) else "unreadable"
    lines = [x for x in lines if x.strip()]
    if not lines:
        return "empty"
    if not lines[0].startswith(">"):
        return "not_fasta"
    letters = "".join(x.strip().upper() for x in lines if not x.startswith(">"))
    return "looks_like_dna" if letters and sum(c in PROBE_BASES for c in letters) / len(letters) > 0.9 else "ok"


def atoms(spark: SparkSession, path: str, chain: str, ions: tuple[str, ...] = ()) -> DataFrame:
    """(chain, resnum, resname, atom, x, y, z, is_ion) of a mmCIF or PDB file: author numbering,
    no hydrogens, one chain; ions by residue name from every chain."""
    lines = spark.read.text(path)
    if path.endswith((".cif", ".cif.gz")):
        names = ordered_lines(spark, path).where(F.col("value").startswith("_atom_site.")).orderBy("ln").select(F.trim(F.regexp_replace("value", "^_atom_site\\.", "")).alias("c"))
        place = {r["c"]: i for i, r in enumerate(names.collect())}
        f = lines.where(F.col("value").rlike("^(ATOM|HETATM)")).select(F.split(F.trim("value"), r"\s+").alias("f"))
        col = lambda *ks: F.get("f", next(place[k] for k in ks if k in place))
        out = f.select(col("group_PDB").alias("kind"), col("auth_asym_id", "label_asym_id").alias("chain"), col("auth_seq_id", "label_seq_id").try_cast("int").alias("resnum"), col("auth_comp_id", "label_comp_id").alias("resname"), F.regexp_replace(col("auth_atom_id", "label_atom_id"), '"', "").alias("atom"), col("type_symbol").alias("element"), *[col(f"Cartn_{a}").try_cast("double").alias(a) for a in "xyz"])
    else:
        cut = lambda a, n: F.trim(F.substring("value", a, n))
        out = lines.where(F.col("value").rlike("^(ATOM|HETATM)")).select(cut(1, 6).alias("kind"), cut(22, 1).alias("chain"), cut(23, 4).try_cast("int").alias("resnum"), cut(18, 3).alias("resname"), cut(13, 4).alias("atom"), cut(77, 2).alias("element"), cut(31, 8).try_cast("double").alias("x"), cut(39, 8).try_cast("double").alias("y"), cut(47, 8).try_cast("double").alias("z"))
    ion = (F.col("kind") == "HETATM") & F.col("resname").isin(*ions) if ions else F.lit(False)
    protein = (F.col("kind") == "ATOM") & (F.col("chain") == chain)
    return out.where((F.coalesce("element", F.lit("")) != "H") & (ion | protein)).select("chain", "resnum", "resname", "atom", "x", "y", "z", ion.alias("is_ion"))
