"""Names, keys and labels: accessions, classes, packed CIGARs and junction keys, lengths, homopolymers, recovered clips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: RefSeq versions of chromosomes 1 to 22, X and Y.
ACCESSION_VERSIONS = {
    "GRCh38": [11, 12, 12, 12, 10, 12, 14, 11, 12, 11, 10, 12, 11, 9, 10, 10, 11, 10, 10, 11, 9, 11, 11, 10],
    "GRCh37": [10, 11, 11, 11, 9, 11, 13, 10, 11, 10, 9, 11, 10, 8, 9, 9, 10, 9, 9, 10, 8, 10, 10, 9],
}
MITOCHONDRION = "NC_012920.1"
#: Operations of a CIGAR in the order of their codes; what a junction's key is multiplied by.
OPERATIONS = "MIDNSHP=X"
KEY = 1 << 23


def accession(build: Column, chrom: Column) -> Column:
    """NC_ accession of a chromosome in a build; null where either is unknown."""
    bare = F.regexp_replace(F.upper(chrom), "^CHR", "")
    number = F.when(bare == "X", 23).when(bare == "Y", 24).when(bare.rlike("^([1-9]|1[0-9]|2[0-2])$"), bare.cast("int"))
    version = F.lit(None).cast("int")
    for name, versions in ACCESSION_VERSIONS.items():
        version = F.when(build == name, F.get(F.array(*[F.lit(v) for v in versions]), number - 1)).otherwise(version)
    named = F.concat(F.lit("NC_"), F.lpad(number.cast("string"), 6, "0"), F.lit("."), version.cast("string"))
    return F.when(bare.isin("M", "MT"), MITOCHONDRION).otherwise(named)


def build_of_accession(acc: Column) -> Column:
    """The build that a versioned NC_ accession belongs to, the newer one first; null where none does."""
    number = F.nullif(F.regexp_extract(F.upper(F.trim(acc)), "^NC_0*([0-9]+)\\.[0-9]+$", 1), F.lit("")).cast("int")
    version = F.nullif(F.regexp_extract(acc, "\\.([0-9]+)", 1), F.lit("")).cast("int")
    out = F.lit(None).cast("string")
    for name in reversed(ACCESSION_VERSIONS):
        out = F.when(F.get(F.array(*[F.lit(v) for v in ACCESSION_VERSIONS[name]]), number - 1) == version, name).otherwise(out)
    return out


def resolved_contig(name: Column, known: Column) -> Column:
    """A contig under the name that a file's header (an array) has for it: as it is, or with chr added or dropped; else null."""
    bare = F.regexp_replace(name, "^chr", "")
    return F.coalesce(*[F.when(F.array_contains(known, x), x) for x in (name, bare, F.concat(F.lit("chr"), bare))])


#: Classes, as files write them in letters and digits alone, in the order they are looked for.
CLASSES = [
    ("probablementpathog|likelypathog|classe?4", "Likely pathogenic"),
    ("pathog|classe?5", "Pathogenic"),
    ("probablementbenin|likelybenign|classe?2", "Likely benign"),
    ("benin|benign|classe?1", "Benign"),
    ("vsi|vus|incertain|uncertain|inconnu|classe?3", "Uncertain significance"),
    ("piev|susceptib", "PIEV"),
    ("temoinfeminin|referencefeminine?|femalereference|femalecontrol", "Female Reference"),
    ("temoinmasculin|referencemasculine?|malereference|malecontrol", "Male Reference"),
    ("^ns$|nonsignificati|nonsignificant|artefact|artifact", "NS"),
]


def class_of(text: Column) -> Column:
    """One of the classes for a text in French or English; null for others."""
    plain = F.regexp_replace(F.translate(F.lower(text), "àâäéèêëîïôöùûüç", "aaaeeeeiioouuuc"), "[^a-z0-9]", "")
    out = F.lit(None).cast("string")
    for pattern, name in reversed(CLASSES):
        out = F.when(plain.rlike(pattern), name).otherwise(out)
    return out


def packed_cigar(ops: Column) -> Column:
    """Operations (n, op) as numbers: length * 16 + code."""
    return F.transform(ops, lambda o: o["n"] * 16 + F.instr(F.lit(OPERATIONS), o["op"]) - 1)


def cigar_of(packed: Column) -> Column:
    letter = lambda x: F.substring(F.lit(OPERATIONS), x % 16 + 1, F.lit(1))
    return F.array_join(F.transform(packed, lambda x: F.concat(F.floor(x / 16).cast("string"), letter(x))), "")


def junction_key(s: Column, e: Column) -> Column:
    """Start and length in one number; lengths from 2^23 on count as 2^23 - 1."""
    return s.cast("long") * KEY + F.least(e - s, F.lit(KEY - 1))


def junction_of(key: Column) -> Column:
    s = F.floor(key / KEY).cast("long")
    return F.struct(s.alias("s"), (s + key % KEY).alias("e"))


def base_label(n: Column) -> Column:
    """A length in bp, kb (one digit) or Mb (two digits), without digits where it is whole."""
    part = lambda unit, digits: F.when(n % unit == 0, F.floor(n / unit).cast("string")).otherwise(F.format_string(f"%.{digits}f", n / unit))
    return F.when(n >= 1_000_000, F.concat(part(1_000_000, 2), F.lit(" Mb"))).when(n >= 1000, F.concat(part(1000, 1), F.lit(" kb"))).otherwise(F.concat(n.cast("string"), F.lit(" bp")))


def homopolymer(seq: Column, at: Column, between: Column) -> Column:
    """Length of the run of one base through position at (from 0); between two bases, the longer of the runs on either side. 0 off the sequence."""

    def through(p: Column) -> Column:
        base = F.substring(seq, p + 1, F.lit(1))
        left = F.reverse(F.substring(seq, F.lit(1), p))
        right = F.substring(seq, p + 1, F.length(seq))
        run = lambda x: F.length(x) - F.length(F.ltrim(x, base))
        return F.when((p >= 0) & (p < F.length(seq)), run(left) + run(right)).otherwise(0)

    return F.when(between, F.greatest(through(at - 1), through(at))).otherwise(through(at))


def hard_clipped(seq: Column, same_strand: Column, left: Column, right: Column, length: Column) -> Column:
    """struct(left, right) of the bases that a part of a read has clipped off, from its primary record's sequence; null where lengths don't add up."""
    whole = F.when(same_strand, seq).otherwise(F.translate(F.reverse(seq), "ACGT", "TGCA"))
    ends = F.struct(F.substring(whole, F.lit(1), left).alias("left"), F.substring(whole, left + length + 1, right).alias("right"))
    return F.when((F.length(seq) > 0) & (F.length(seq) == left + length + right), ends)


def in_blocks(blocks: Column, pos: Column, inner: bool = False) -> Column:
    """Whether a position lies in one of the blocks (s, e); inner: not at its first base."""
    return F.exists(blocks, lambda b: ((b["s"] < pos) if inner else (b["s"] <= pos)) & (pos < b["e"]))


#: Other names of chromosomes.
ALIASES = {"MT": "M", "23": "X", "24": "Y"}


def known_chromosome(name: Column) -> Column:
    """chr1 to chr22, chrX, chrY or chrM of a chromosome under any of its names, with chr before it or not; empty for others."""
    plain = {n: n for n in [*map(str, range(1, 23)), "X", "Y", "M"]} | ALIASES
    table = F.create_map(*[F.lit(x) for n, c in plain.items() for x in (n, f"chr{c}")])
    key = F.regexp_extract(F.upper(F.trim(F.coalesce(name, F.lit("")))), "^(?:CHR)?(.*)$", 1)
    return F.coalesce(F.try_element_at(table, key), F.lit(""))


#: Terms of a consequence, by what they mean for the protein, the gravest first.
EFFECT_TERMS = {
    "lof": ["nonsense", "stop gained", "frameshift", "splice donor", "splice acceptor", "initiator codon", "start lost"],
    "missense": ["missense"],
    "inframe": ["inframe", "in-frame", "stop lost"],
}
#: How notations write a stop.
STOPS = ["Ter", "*", "X"]


def variant_effect(consequence: Column, protein: Column) -> Column:
    """lof, missense, inframe or other: the gravest term of the consequence; without a consequence, what the protein's notation says became of its amino acid."""
    words = F.translate(F.lower(F.coalesce(consequence, F.lit(""))), "_", " ")
    graded = [(name, F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(words, t))) for name, terms in EFFECT_TERMS.items()]
    # p.(Gly12Asp): the amino acid, its place, and what stands there now
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(protein, F.lit("")), "^p\\.", ""), "[()]", "")
    became = F.regexp_extract(bare, "^[A-Za-z*]+[0-9]+(.*)$", 1)
    by_protein = F.when(F.array_contains(F.array(*[F.lit(x) for x in STOPS]), became) | F.contains(bare, F.lit("fs")), "lof").when((F.length(became) == 3) & (F.initcap(became) == became) & ~F.contains(became, F.lit("=")), "missense").otherwise("other")
    out = F.when(words == "", by_protein).otherwise("other")
    for name, met in reversed(graded):
        out = F.when(met, name).otherwise(out)
    return out


#: The fields of a population record that matter here.
RECORD = "name string, chromStart double, chromEnd double, thickStart double, thickEnd double, freq string"


def population_record(text: Column) -> Column:
    """struct(id, os, oe, is_, ie, freq) of a record in JSON: the thick part is the inner extent where it lies within the outer one; a frequency with a percent sign or above 1 is a percentage. Null without usable coordinates."""
    r = F.from_json(text, RECORD)
    s, e, a, b = (r[c].cast("long") for c in ("chromStart", "chromEnd", "thickStart", "thickEnd"))
    good = F.coalesce((b > a) & (a >= s) & (b <= e), F.lit(False))
    share = F.nullif(F.regexp_extract(r["freq"], "([0-9]*\\.?[0-9]+)", 1), F.lit("")).cast("double")
    freq = F.when(F.contains(r["freq"], F.lit("%")) | (share > 1), share / 100).otherwise(share)
    out = F.struct(r["name"].alias("id"), s.alias("os"), e.alias("oe"), F.when(good, a).otherwise(s).alias("is_"), F.when(good, b).otherwise(e).alias("ie"), freq.alias("freq"))
    return F.when(e > s, out)
