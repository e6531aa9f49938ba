"""Interval, order and sequence queries.  Intervals: ``lineitem`` of an order, from its ship day
over l_quantity days, ranked by discount; gene order: ``events`` of a user by time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import intervals as V
from ..operators import sequences as Q
from ..operators import synteny as Y
from .registry import query, spread, table
from .screen import CLEAN_SQL

def hits(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date"))
    return li.select(F.col("l_orderkey").alias("item"), day.alias("env_from"), (day + F.col("l_quantity")).cast("int").alias("env_to"), F.col("l_discount").alias("ev"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), F.col("l_returnflag").alias("label"))


RANK = ("ev", "ln", "pk", "sk", "env_from")


def _kept(h):
    return V.resolve_overlaps(h, "item", "env_from", "env_to", [F.col(c) for c in RANK])


_HITS = "h AS (SELECT l_orderkey AS item, datediff('day', DATE '1992-01-01', l_shipdate::DATE) AS a, (datediff('day', DATE '1992-01-01', l_shipdate::DATE) + l_quantity)::INT AS b, l_discount AS ev, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, l_returnflag AS label FROM lineitem)"


def _resolved_sql(n, where="true"):
    """Common table r{n}: hits taken one after another, each against all that its item has kept."""
    both = "(least(x.b, o.b) - greatest(x.a, o.a) + 1)"
    return f"""o{n} AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY ev, ln, pk, sk, a) AS k, count(*) OVER (PARTITION BY item) AS n FROM h WHERE {where}),
g{n} AS (SELECT item, k, n, [{{'a': a, 'b': b, 'ev': ev, 'ln': ln, 'pk': pk, 'sk': sk, 'label': label}}] AS kept FROM o{n} WHERE k = 1
 UNION ALL SELECT g.item, o.k, g.n, CASE WHEN len(list_filter(kept, lambda x: {both} > 0 AND {both} / (least(x.b - x.a, o.b - o.a) + 1) > 0.4::DOUBLE)) > 0 THEN kept ELSE list_append(kept, {{'a': o.a, 'b': o.b, 'ev': ev, 'ln': ln, 'pk': pk, 'sk': sk, 'label': label}}) END FROM g{n} g JOIN o{n} o ON o.item = g.item AND o.k = g.k + 1),
r{n} AS (SELECT item, x.* FROM (SELECT item, unnest(kept) AS x FROM g{n} WHERE k = n))"""


@query(f"WITH RECURSIVE {_HITS}, {_resolved_sql(1)} SELECT item, a AS env_from, b AS env_to, ev, ln, pk, sk, label FROM r1")
def interval_resolve(spark, sf_dir):
    return _kept(hits(spark, sf_dir)).select("item", "env_from", "env_to", "ev", "ln", "pk", "sk", "label")


@query("""
WITH h AS (SELECT l_orderkey AS item, l_shipdate AS s, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, l_extendedprice AS ep, l_returnflag AS label FROM lineitem),
n AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY item, label ORDER BY s, ln, pk, sk, ep, label) AS j FROM h WINDOW w AS (PARTITION BY item ORDER BY s, ln, pk, sk, ep, label)),
r AS (SELECT item, label, i - j AS isl, count(*) AS n, min(i) AS first FROM n GROUP BY ALL)
SELECT item, string_agg(label || CASE WHEN n > 1 THEN 'x' || n ELSE '' END, '-' ORDER BY r.first) AS architecture FROM r GROUP BY item""")
def architecture_string(spark, sf_dir):
    h = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_shipdate").alias("s"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), F.col("l_extendedprice").alias("ep"), F.col("l_returnflag").alias("label"))
    return V.architecture(h, "item", "s", "label", ["ln", "pk", "sk", "ep"])


@query(f"""WITH RECURSIVE {_HITS}, {_resolved_sql(1, "ev <= 0.05")}, {_resolved_sql(2, "ev <= 0.08")},
s AS (SELECT item, count(*) FILTER (label = 'N') AS nb, count(*) FILTER (label = 'R') AS nc, count(*) AS nd, count(*) FILTER (label = 'A') AS na, last(label ORDER BY a, ln, pk, sk, label) AS final,
 string_agg(a || '-' || b, ';' ORDER BY a, b) FILTER (label = 'N') AS bs, string_agg(a || '-' || b, ';' ORDER BY a, b) FILTER (label = 'R') AS cs FROM r1 GROUP BY item),
l AS (SELECT item, count(*) FILTER (label = 'N') AS nl FROM r2 GROUP BY item),
n AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY item, label ORDER BY a, ln, pk, sk) AS j FROM r1 WINDOW w AS (PARTITION BY item ORDER BY a, ln, pk, sk, label)),
u AS (SELECT item, label, i - j AS isl, count(*) AS n, min(i) AS at FROM n GROUP BY ALL),
t AS (SELECT item, string_agg(label || CASE WHEN n > 1 THEN 'x' || n ELSE '' END, '-' ORDER BY u.at) AS arch FROM u GROUP BY item),
z AS (SELECT o_orderkey AS item, coalesce(nb, 0) AS nb, coalesce(nc, 0) AS nc, coalesce(nd, 0) AS nd, coalesce(na, 0) AS na, coalesce(nl, 0) AS nl, coalesce(final = 'R', false) AS last_ok, coalesce(arch, '') AS arch, coalesce(bs, '') AS bs, coalesce(cs, '') AS cs
 FROM orders LEFT JOIN s ON s.item = o_orderkey LEFT JOIN l ON l.item = o_orderkey LEFT JOIN t ON t.item = o_orderkey)
SELECT item, nb AS n_binding, nc AS n_catalytic, nd AS n_domains, nl AS n_binding_permissive, CASE WHEN na > 0 THEN 'A' ELSE '' END AS accessory_domains, last_ok::INT AS catalytic_is_last, arch AS architecture, bs AS binding_span, cs AS catalytic_span,
 ((nb >= 3) <> (nl >= 3))::INT AS count_fragile, (nb >= 3)::INT AS binding_competent, (nb > 0)::INT AS rule_applies, CASE WHEN nb >= 3 THEN 'pseudomurein_sacculus' WHEN nb = 2 THEN 'murein_fragments_only' WHEN nb = 1 THEN 'none' ELSE 'no_pmbr_module' END AS predicted_binding,
 CASE WHEN (nb >= 3) <> (nl >= 3) THEN 'count_ambiguous' WHEN nb = 0 AND na > 0 THEN 'accessory_binding' WHEN nb = 0 THEN 'catalytic_only' WHEN nb >= 3 THEN 'canonical' ELSE 'reduced' END AS architecture_class FROM z""")
def architecture_table(spark, sf_dir):
    h = hits(spark, sf_dir)
    strict, loose = _kept(h.where("ev <= 0.05")), _kept(h.where("ev <= 0.08"))
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"))
    return V.architecture_table(items, strict, loose, "item", "env_from", "env_to", "label", "N", "R", ["A"], ["ln", "pk", "sk"])


@query("""
WITH n AS (SELECT c_custkey AS id, c_custkey % 5 AS n FROM customer)
SELECT id, CASE WHEN n >= 3 THEN 'pseudomurein_sacculus' WHEN n = 2 THEN 'murein_fragments_only' WHEN n = 1 THEN 'none' ELSE 'no_pmbr_module' END AS call, n >= 3 AS binds_wall, n > 0 AS applies FROM n""")
def binding_rule(spark, sf_dir):
    n = F.col("c_custkey") % 5
    call = V.binding_call(n)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), call["call"].alias("call"), call["binds_wall"].alias("binds_wall"), V.rule_applies(n).alias("applies"))


ORDER_SQL = """
e AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord FROM events),
r AS (SELECT user_id, event_id, ord, CASE event_type WHEN 'signup' THEN 'muramyl_ligase' WHEN 'error' THEN 'mray_like' WHEN 'purchase' THEN 'cps' END AS role FROM e WHERE event_type IN ('signup', 'error', 'purchase') AND value > (SELECT quantile_cont(value, 0.8) FROM events))"""


def genes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return Y.gene_order(e, "user_id", "user_id", "ts", ["event_id"])


@query(f"""
WITH {ORDER_SQL}, a AS (SELECT user_id, count(DISTINCT role) AS roles, max(ord) - min(ord) AS span, max(event_id) - min(event_id) AS bp FROM r GROUP BY 1)
SELECT user_id, CASE WHEN roles < 3 THEN 'not_evaluable' WHEN span <= 20 THEN 'syntenic' WHEN user_id % 4 = 0 THEN 'not_evaluable' ELSE 'dispersed' END AS status, CASE WHEN roles = 3 THEN span END AS span_genes FROM a""")
def synteny_block(spark, sf_dir):
    g = genes(spark, sf_dir)
    bar = g.agg(F.percentile("value", F.lit(0.8)).alias("_bar"))
    role = F.when(F.col("event_type") == "signup", Y.ROLES[0]).when(F.col("event_type") == "error", Y.ROLES[1]).when(F.col("event_type") == "purchase", Y.ROLES[2])
    found = g.crossJoin(F.broadcast(bar)).where(F.col("value") > F.col("_bar")).select("user_id", "event_id", role.alias("role")).where("role is not null")
    coords = g.select("user_id", "event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("contig"), F.col("event_id").alias("start"), F.col("event_id").alias("end"), "order")
    contigs = g.select("user_id").distinct().withColumn("n_contigs", F.when(F.col("user_id") % 4 != 0, 10))
    return Y.block_synteny(found, coords, contigs, "user_id", "event_id", window_genes=20).select("user_id", "status", "span_genes")


MARK_SQL = """
m AS (SELECT c_custkey AS id, c_acctbal, n_regionkey AS r, (c_custkey % 3 = 0)::INT AS lig1, (c_custkey % 11 = 0)::INT AS lig2, (c_custkey % 2 = 0)::INT AS mray, (c_custkey % 5 < 2)::INT AS cps FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def marked(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    lineage = F.when(F.col("n_regionkey") == 0, "d__Archaea;o__Methanobacteriales").when(F.col("n_regionkey") == 1, "d__Archaea; o__Methanopyrales ;s__x").when(F.col("n_regionkey") == 2, "d__Archaea;o__")
    return c.select(k.alias("id"), "c_acctbal", lineage.alias("lineage"), (k % 3 == 0).cast("int").alias("lig1"), (k % 11 == 0).cast("int").alias("lig2"), (k % 2 == 0).cast("int").alias("mray"), (k % 5 < 2).cast("int").alias("cps"))


@query(f"""
WITH {MARK_SQL}
SELECT id, lig1 + lig2 + mray + cps AS n_markers, (lig1 + lig2 >= 1 AND mray = 1 AND cps = 1)::INT AS block_present, CASE WHEN r IN (0, 1) THEN 'expected_by_taxonomy' WHEN lig1 + lig2 >= 1 AND mray = 1 AND cps = 1 THEN 'candidate_out_of_order'
 WHEN lig1 + lig2 + mray + cps > 0 THEN 'markers_without_block' WHEN c_acctbal < 90 THEN 'indeterminate_low_completeness' ELSE 'no_pathway_detected' END AS pathway_call FROM m""")
def pathway_calls(spark, sf_dir):
    out = Y.pathway_calls(marked(spark, sf_dir), ["lig1", "lig2"], ["mray"], ["cps"], S.lineage_order(F.col("lineage")), "c_acctbal")
    return out.select("id", "n_markers", "block_present", "pathway_call")


@query(f"""
WITH {MARK_SQL}, c AS (SELECT id, CASE WHEN r IN (0, 1) THEN 'expected_by_taxonomy' WHEN lig1 + lig2 >= 1 AND mray = 1 AND cps = 1 THEN 'candidate_out_of_order' WHEN lig1 + lig2 + mray + cps > 0 THEN 'markers_without_block' WHEN c_acctbal < 90 THEN 'indeterminate_low_completeness' ELSE 'no_pathway_detected' END AS call,
 (r IN (0, 1)) AS ex, (lig1 + lig2 >= 1 AND mray = 1 AND cps = 1) AS bl FROM m)
SELECT id, CASE WHEN call = 'candidate_out_of_order' THEN call || CASE id % 4 WHEN 0 THEN '_syntenic' WHEN 2 THEN '_dispersed' ELSE '_synteny_unknown' END WHEN NOT ex AND NOT bl AND id % 7 = 0 THEN 'candidate_out_of_order_divergent_syntenic' ELSE call END AS pathway_call FROM c""")
def refined_calls(spark, sf_dir):
    calls = Y.pathway_calls(marked(spark, sf_dir), ["lig1", "lig2"], ["mray"], ["cps"], S.lineage_order(F.col("lineage")), "c_acctbal")
    strict = calls.select("id", F.when(F.col("id") % 4 == 0, "syntenic").when(F.col("id") % 4 == 2, "dispersed").otherwise("not_evaluable").alias("status"))
    loose = calls.select("id", F.when(F.col("id") % 7 == 0, "syntenic").otherwise("dispersed").alias("status"))
    return Y.refine_calls(calls, strict, loose, "id").select("id", "pathway_call")


@query("""
WITH n AS (SELECT p_partkey AS id, ['x_OG0001148.hmm', 'murgamma', 'OG0001163_v2', 'cps_og1014', 'MurT_like', 'FPGS', 'plain'][p_partkey % 7 + 1] AS name FROM part)
SELECT id, CASE WHEN name IN ('MurT_like', 'FPGS') THEN 'trap' WHEN name IN ('x_OG0001148.hmm', 'murgamma') THEN 'ligase' WHEN name = 'OG0001163_v2' THEN 'mray' WHEN name = 'cps_og1014' THEN 'cps' ELSE 'own' END AS role FROM n""")
def marker_roles(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("x_OG0001148.hmm", "murgamma", "OG0001163_v2", "cps_og1014", "MurT_like", "FPGS", "plain")])
    name = F.get(names, (F.col("p_partkey") % 7).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), Y.marker_role(name, {"plain": "own"}).alias("role"))


@query("""
WITH t AS (SELECT l_returnflag AS model, CASE l_returnflag WHEN 'A' THEN 30 WHEN 'N' THEN 45 END AS cutoff FROM lineitem GROUP BY 1)
SELECT l_suppkey AS entity, t.model, max(l_quantity) AS best_score, max((l_quantity >= coalesce(cutoff, 40))::INT) AS present FROM lineitem JOIN t ON model = l_returnflag WHERE l_quantity >= 30 GROUP BY ALL""")
def marker_presence(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_returnflag").alias("model"), F.col("l_quantity").alias("score"))
    models = spark.sql("SELECT * FROM VALUES ('A', 30D), ('N', 45D), ('R', cast(null as double)) AS t(model, cutoff)")
    return Y.marker_presence(s, models, "entity", 40.0)


SEQ_SQL = f"q AS (SELECT doc_id AS id, {CLEAN_SQL} AS s FROM documents)"
NT_SQL = f"{SEQ_SQL}, nt AS (SELECT id, translate(s, 'DEFHIKLMNOPQRSUVWXYBZ', 'ACGTACGTACGTACGUACGTN') AS nt FROM q WHERE s IS NOT NULL)"


def sequences(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).where(S.has_sequence(F.col("text")))
    return docs.select(F.col("doc_id").alias("id"), S.clean_sequence(F.col("text")).alias("s"))


def nucleotides(spark, sf_dir):
    return sequences(spark, sf_dir).select("id", "s", F.translate("s", "DEFHIKLMNOPQRSUVWXYBZ", "ACGTACGTACGTACGUACGTN").alias("nt"))


_CODON = "CASE WHEN regexp_full_match(c, '[ACGT]{3}') THEN '" + S.CODE + "'[(instr('TCAG', c[1]) - 1) * 16 + (instr('TCAG', c[2]) - 1) * 4 + instr('TCAG', c[3])] ELSE 'X' END"


@query(f"""
WITH {NT_SQL}, k AS (SELECT id, i, substr(replace(nt, 'U', 'T'), i * 3 + 1, 3) AS c FROM (SELECT id, nt, unnest(range(0, length(nt) // 3)) AS i FROM nt)), p AS (SELECT id, string_agg({_CODON}, '' ORDER BY i) AS protein FROM k GROUP BY id)
SELECT nt.id, coalesce(protein, '') AS protein FROM nt LEFT JOIN p ON p.id = nt.id""")
def codon_translate(spark, sf_dir):
    return nucleotides(spark, sf_dir).select("id", S.translate_codons(F.col("nt")).alias("protein"))


RF = "xxx.xx.xxxxx..xxxx"
STEP, BEFORE = 16, 4
MAP_SQL = f"""{SEQ_SQL}, e AS (SELECT id, s, unnest(range(0, (length(s) + {STEP - 1}) // {STEP})) AS k FROM q WHERE s IS NOT NULL),
f AS (SELECT id, k, s, {STEP} * k + 1 AS i0, greatest(1, {STEP} * k + 1 - {BEFORE}) AS p0 FROM e),
a AS (SELECT id, k, substr(s, p0, i0 + {STEP} - p0) AS p, rpad(substr(s, i0, 6) || '-' || substr(s, i0 + 6, 4) || '.' || substr(s, i0 + 10, 6), {len(RF)}, '-') AS al FROM f),
o AS (SELECT *, instr(p, regexp_replace(al, '[-.]', '', 'g')) - 1 AS off FROM a),
c AS (SELECT id, k, p, i, substr(al, i, 1) AS c, substr('{RF}', i, 1) AS m, off FROM o, range(1, {len(RF) + 1}) t(i) WHERE off >= 0),
x AS (SELECT id, k, p, i, m, c, off + sum((c NOT IN ('-', '.'))::INT) OVER (PARTITION BY id, k ORDER BY i) - (c NOT IN ('-', '.'))::INT AS r FROM c),
v AS (SELECT id, k, any_value(p) AS p, array_to_string(list(CASE WHEN c IN ('-', '.') THEN 'null' ELSE r::BIGINT::VARCHAR END ORDER BY i) FILTER (m = 'x'), ',') AS residue_index FROM x GROUP BY id, k)"""


def stretches(spark, sf_dir, step):
    """(id, k, part): a row for each stretch of ``step`` letters of a whole sequence."""
    return sequences(spark, sf_dir).select("id", F.posexplode(S.pieces(F.col("s"), step)).alias("k", "part"))


def _aligned(spark, sf_dir):
    """Every stretch of each sequence, with two gaps put into it, and its protein: the stretch
    and up to BEFORE letters before it."""
    parts = sequences(spark, sf_dir).withColumn("parts", S.pieces(F.col("s"), STEP))
    whole = lambda x, k: F.struct(x.alias("part"), F.concat(F.coalesce(F.right(F.get(F.col("parts"), k - 1), F.lit(BEFORE)), F.lit("")), x).alias("p"))
    s = parts.select("id", F.posexplode(F.transform("parts", whole)).alias("k", "x")).select("id", "k", "x.*")
    cut = lambda at, n: F.substring("part", at, n)
    al = F.rpad(F.concat(cut(1, 6), F.lit("-"), cut(7, 4), F.lit("."), cut(11, 6)), len(RF), "-")
    s = s.select("id", "k", "p", al.alias("al")).withColumn("off", Q.fragment_offset(F.col("al"), F.col("p"))).where("off is not null")
    return s.withColumn("ix", Q.residue_index(F.col("al"), F.lit(RF), F.col("off")))


@query(f"WITH {MAP_SQL} SELECT id, k, residue_index FROM v")
def residue_index_map(spark, sf_dir):
    return _aligned(spark, sf_dir).select("id", "k", F.array_join(F.col("ix").cast("array<string>"), ",", "null").alias("residue_index"))


@query(f"""WITH {MAP_SQL}, r AS (SELECT id, k, p || p || CASE WHEN k % 4 = 3 THEN substr(p, 4) ELSE p END AS cds, unnest(string_split(residue_index, ',')) AS r, unnest(range(1, len(string_split(residue_index, ',')) + 1)) AS i FROM v)
SELECT id, k, string_agg(CASE WHEN r = 'null' THEN '---' ELSE substr(cds, 3 * r::BIGINT + 1, 3) END, '' ORDER BY i) AS codons FROM r GROUP BY id, k HAVING bool_and(r = 'null' OR 3 * try_cast(r AS BIGINT) + 3 <= length(cds))""")
def codon_align(spark, sf_dir):
    """Letters three times over stand for the coding sequence; every fourth is one codon short, and
    rows that use its last residue go."""
    last = F.when(F.col("k") % 4 == 3, F.substring(F.col("p"), F.lit(4), F.length("p"))).otherwise(F.col("p"))
    s = _aligned(spark, sf_dir).withColumn("cds", F.concat("p", "p", last))
    return s.select("id", "k", Q.codon_row(F.col("ix"), F.col("cds")).alias("codons")).where("codons is not null")


_CH = "1 / (1 + 10 ** (m - 9.69)) - 1 / (1 + 10 ** (2.34 - m)) + k / (1 + 10 ** (m - 10.0)) + r / (1 + 10 ** (m - 12.0)) + h / (1 + 10 ** (m - 6.0)) - d / (1 + 10 ** (4.05 - m)) - e / (1 + 10 ** (4.45 - m)) - c / (1 + 10 ** (9.0 - m)) - y / (1 + 10 ** (10.0 - m))"


@query(f"""
WITH RECURSIVE {SEQ_SQL}, n AS (SELECT id, {', '.join(f"length(s) - length(replace(s, '{x.upper()}', '')) AS {x}" for x in 'krhdecy')} FROM q WHERE s IS NOT NULL),
b AS (SELECT id, k, r, h, d, e, c, y, 0.0::DOUBLE AS lo, 14.0::DOUBLE AS hi, 7.0::DOUBLE AS m, 0 AS step FROM n
 UNION ALL SELECT id, k, r, h, d, e, c, y, nlo, nhi, (nlo + nhi) / 2, step + 1 FROM (SELECT *, CASE WHEN {_CH} > 0 THEN m ELSE lo END AS nlo, CASE WHEN {_CH} > 0 THEN hi ELSE m END AS nhi FROM b WHERE step < 18))
SELECT id, round(m, 2) AS pi FROM b WHERE step = 18""")
def isoelectric_point(spark, sf_dir):
    return sequences(spark, sf_dir).select("id", S.isoelectric_point(F.col("s")).alias("pi"))


@query("""
WITH s AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 3), d AS (SELECT vec_id AS point_id, min(sqrt(list_sum(list_transform(list_zip(embedding::DOUBLE[], s.v), lambda z: (z[1] - z[2]) ** 2)))) AS d FROM embeddings, s GROUP BY 1)
SELECT point_id, round(d, 6) AS distance, d <= 9 AS in_region FROM d""")
def region_distance(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return Q.region_distance(e, e.where("point_id < 3"), 9.0).withColumn("distance", F.round("distance", 6))


@query(f"""WITH {SEQ_SQL} SELECT id, 'b1_s' || lpad(id::VARCHAR, 8, '0') AS target, 'p' || id AS protein_id, 'g' || id % 7 AS sample, (SELECT count(*) FROM q WHERE s IS NOT NULL) AS n FROM q WHERE s IS NOT NULL""")
def provenance_decode(spark, sf_dir):
    s = sequences(spark, sf_dir)
    header = S.provenance(F.lit(1), F.col("id"), F.concat(F.lit("p"), F.col("id").cast("string")), F.concat(F.lit("g"), (F.col("id") % 7).cast("string")))
    part = S.provenance_parts(header)
    return s.select("id", part["target"].alias("target"), part["protein_id"].alias("protein_id"), part["sample"].alias("sample")).crossJoin(F.broadcast(s.agg(F.count("*").alias("n"))))


@query(f"""WITH {SEQ_SQL}, e AS (SELECT id, s, unnest(range(0, (length(s) + {len(RF) - 1}) // {len(RF)})) AS k FROM q WHERE s IS NOT NULL),
a AS (SELECT id, k, rpad(substr(s, {len(RF)} * k + 1, {len(RF)}), {len(RF)}, '.') AS al FROM e) SELECT id, k, {' || '.join(f"replace(al[{i + 1}], '.', '-')" for i, c in enumerate(RF) if c == 'x')} AS projected FROM a""")
def match_projection(spark, sf_dir):
    al = F.rpad("part", len(RF), ".")
    return stretches(spark, sf_dir, len(RF)).select("id", "k", S.match_projection(al, RF).alias("projected"))


@query(f"""WITH {SEQ_SQL} SELECT id, substr(s, 3, 8) || substr(s, 15, 6) AS module FROM q WHERE s IS NOT NULL""")
def span_slices(spark, sf_dir):
    return sequences(spark, sf_dir).select("id", S.span_slices(F.col("s"), F.lit("3-10;15-20")).alias("module"))
