"""Scalar expressions over columns.  All are built-in expressions; none runs Python."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabet import SEQUENCE_LETTERS


def clean_sequence(s: Column, letters: str = SEQUENCE_LETTERS) -> Column:
    """Upper case, only ``letters`` kept; nothing left is null."""
    return F.nullif(F.upper(F.regexp_replace(s, f"[^{letters}{letters.lower()}]+", "")), F.lit(""))


def has_sequence(s: Column, letters: str = SEQUENCE_LETTERS) -> Column:
    """Whether ``clean_sequence`` leaves anything; stops at the first letter."""
    return s.rlike(f"[{letters}{letters.lower()}]")


def pieces(s: Column, n: int) -> Column:
    """Array of the stretches of ``n`` characters of a text, the last one what is left; cut in one pass (a substring
    by place starts from the front each time, and a row for each place copies the text)."""
    return F.regexp_extract_all(s, F.lit(f"(?s).{{1,{n}}}"), F.lit(0))


def match_projection(aligned: Column, rf: Column | str) -> Column:
    """The characters of ``aligned`` in match columns of ``rf`` (not one of ``.-~_``), upper
    case, with ``.`` and ``~`` as gaps.  Runs of match columns of a fixed ``rf`` are cut whole."""
    if isinstance(rf, str):
        runs = [F.substring(aligned, m.start() + 1, len(m[0])) for m in re.finditer(r"[^.\-~_]+", rf)]
        return F.translate(F.upper(F.concat(*runs)), ".~", "--") if runs else F.when(aligned.isNotNull(), "")
    places = F.filter(F.sequence(F.lit(1), F.length(rf)), lambda i: ~F.substring(rf, i, F.lit(1)).isin(".", "-", "~", "_"))
    return F.translate(F.upper(F.array_join(F.transform(places, lambda i: F.substring(aligned, i, F.lit(1))), "")), ".~", "--")


def lineage_rank(lineage: Column, prefix: str) -> Column:
    """The field of a ``;`` lineage that starts with ``prefix`` and says more than it."""
    fields = F.transform(F.split(lineage, ";"), lambda x: F.trim(x))
    return F.get(F.filter(fields, lambda x: x.startswith(prefix) & (F.length(x) > 3)), 0)


def lineage_order(lineage: Column) -> Column:
    """The ``o__`` field, as it stands even if bare."""
    return F.get(F.filter(F.transform(F.split(lineage, ";"), lambda x: F.trim(x)), lambda x: x.startswith("o__")), 0)


def clean_rank(s: Column) -> Column:
    return F.nullif(F.regexp_replace(F.trim(s), "^[a-z]__", ""), F.lit(""))


def domain_name(s: Column) -> Column:
    """``d__`` off; Bacteria and Archaea in one spelling, others as they are; blank is null."""
    bare = F.nullif(F.regexp_replace(F.trim(s), "^d__", ""), F.lit(""))
    low = F.lower(bare)
    return F.when(low.isin("bacteria", "archaea"), F.initcap(low)).otherwise(bare)


def valid_species(s: Column) -> Column:
    return F.coalesce((F.length(F.trim(s)) > 3) & ~F.trim(s).rlike("^[a-z]__$"), F.lit(False))


def genus_of(species: Column) -> Column:
    """``s__Genus epithet`` to ``g__Genus``."""
    genus = F.regexp_extract(species, r"^s__(\S+)", 1)
    return F.when(genus != "", F.concat(F.lit("g__"), genus))


def accession_variants(acc: Column) -> Column:
    """Spellings of an accession in order of preference: as given, without source prefix,
    without version, with each prefix, and across the two collections."""
    bare = F.regexp_replace(F.trim(acc), "^(GB_|RS_)", "")
    stem = F.regexp_replace(bare, r"\.\d+$", "")
    other = F.when(bare.startswith("GCA_"), F.regexp_replace(bare, "^GCA_", "GCF_")).when(bare.startswith("GCF_"), F.regexp_replace(bare, "^GCF_", "GCA_"))
    other_stem = F.regexp_replace(other, r"\.\d+$", "")
    with_prefix = lambda x: [F.concat(F.lit("GB_"), x), F.concat(F.lit("RS_"), x)]
    return F.array_distinct(F.array_compact(F.array(F.trim(acc), bare, stem, *with_prefix(bare), other, other_stem, *with_prefix(other))))


def profile_coverage(start: Column, end: Column, length: Column) -> Column:
    return ((end - start + 1) / length).cast("float")


def listed(item: str | Column, joined: Column) -> Column:
    """Whether a comma list holds an item (never a substring of one)."""
    return F.coalesce(F.array_contains(F.split(joined, ","), item), F.lit(False))


def log10_floor(x: Column, floor: float = 1.0) -> Column:
    """log10 of x, at least ``floor``; null stays null."""
    return F.when(x.isNotNull(), F.log10(F.greatest(x, F.lit(floor))))


def minus_log10(e: Column, floor: float = 1e-300) -> Column:
    return F.when(e.isNotNull(), -F.log10(F.greatest(e, F.lit(floor))))


def provenance(batch: Column, number: Column, protein: Column, sample: Column) -> Column:
    """Header ``b<batch>_s<8 digits> <protein> <sample>``."""
    return F.concat(F.lit("b"), batch.cast("string"), F.lit("_s"), F.lpad(number.cast("string"), 8, "0"), F.lit(" "), protein, F.lit(" "), sample)


def provenance_parts(header: Column) -> Column:
    parts = F.split(F.trim(header), r"\s+", 3)
    return F.struct(parts[0].alias("target"), F.coalesce(F.get(parts, 1), parts[0]).alias("protein_id"), F.get(parts, 2).alias("sample"))


#: Bases in table order; amino letters of the standard bacterial code in that order.
BASES = "TCAG"
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def translate_codons(nt: Column) -> Column:
    """Protein letters of whole codons; U is T, an unknown codon is X, a rest is ignored."""
    dna = F.translate(F.upper(nt), "U", "T")
    at = lambda codon, k: F.call_function("locate", F.substring(codon, F.lit(k), F.lit(1)), F.lit(BASES)) - 1

    def one(codon: Column) -> Column:
        known = codon.rlike(f"^[{BASES}]{{3}}$")
        return F.when(known, F.substring(F.lit(CODE), at(codon, 1) * 16 + at(codon, 2) * 4 + at(codon, 3) + 1, F.lit(1))).otherwise("X")

    # codons are cut in one pass: a substring by place would start from the front each time
    return F.array_join(F.transform(F.regexp_extract_all(dna, F.lit("(.{3})"), F.lit(1)), one), "")


def span_slices(seq: Column, spans: Column) -> Column:
    """Concatenated 1-based inclusive slices named by ``a-b;c-d``."""
    parts = F.filter(F.split(spans, ";"), lambda x: x.rlike(r"^\d+-\d+$"))
    return F.array_join(F.transform(parts, lambda x: F.substring(seq, F.split(x, "-")[0].cast("int"), F.split(x, "-")[1].cast("int") - F.split(x, "-")[0].cast("int") + 1)), "")


#: pK of the amino terminus and of basic side chains; of the carboxyl terminus and acidic ones.
PK_POSITIVE = {"N_TERM": 9.69, "K": 10.0, "R": 12.0, "H": 6.0}
PK_NEGATIVE = {"C_TERM": 2.34, "D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}


def isoelectric_point(seq: Column, steps: int = 18) -> Column:
    """pH of zero net charge by bisection of [0, 14]; null for an empty sequence."""
    sides = [r for r in (*PK_POSITIVE, *PK_NEGATIVE) if not r.endswith("_TERM")]
    counts = F.struct(*[(F.length(seq) - F.length(F.replace(seq, F.lit(r), F.lit("")))).cast("double").alias(r) for r in sides])

    def charge(n: Column, ph: Column) -> Column:
        of = lambda r: F.lit(1.0) if r.endswith("_TERM") else n[r]
        plus = [of(r) / (1 + F.pow(F.lit(10.0), ph - pk)) for r, pk in PK_POSITIVE.items()]
        minus = [of(r) / (1 + F.pow(F.lit(10.0), pk - ph)) for r, pk in PK_NEGATIVE.items()]
        return sum(plus[1:], plus[0]) - sum(minus[1:], minus[0])

    def solve(n: Column) -> Column:
        def halve(s: Column, _: Column) -> Column:
            mid = (s["lo"] + s["hi"]) / 2
            up = charge(n, mid) > 0
            return F.struct(F.when(up, mid).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi"))

        start = F.struct(F.lit(0.0).alias("lo"), F.lit(14.0).alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: F.round((s["lo"] + s["hi"]) / 2, 2))

    # residues are counted once, as the one element of an array that the bisection runs over
    return F.when(F.length(seq) > 0, F.get(F.transform(F.array(counts), solve), 0))


def support_value(label: Column) -> Column:
    """A clade's support: the last ``/`` part, where it is a number."""
    return F.element_at(F.split(label, "/"), -1).try_cast("double")


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"(\.fna\.gz|\.fna|\.fa|\.fasta)$", "")


def ph_advice(pi: Column, assay: float = 7.0, near: float = 1.0) -> Column:
    """How a point of zero net charge sits to the pH of an assay."""
    far = F.format_string("pI %.1f: test binding near that pH; a negative at the assay pH may be one of binding", pi)
    close = F.format_string(f"pI %.1f: near the assay pH of {assay}; look at aggregation before reading a negative", pi)
    return F.when(pi.isNull(), "no binding region, so its pH does not matter").when(F.abs(pi - assay) < near, close).otherwise(far)


def sister_path(path: Column, old: str = "faa", new: str = "gff") -> Column:
    """The file beside another, with another suffix."""
    return F.regexp_replace(path, rf"\.{old}$", f".{new}")
