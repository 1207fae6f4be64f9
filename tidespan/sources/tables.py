"""Text tables of calls and regions as DataFrames: interval tables, BED, VCF, benign lists, gene panels, sessions; and calls written back.

Readers take lines (file, line_no, line), so that any store Spark reads will do, and return rows; what is not read comes
back with its reason from rejects().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidespan.operators.cgh import chromosome, kind_of_text


def lines_of(spark, path: str) -> DataFrame:
    """(file, line_no, line) of text files. Lines are numbered within their file, which is read whole by one task; a file is one patient's table."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^﻿", "").alias("text"))
    return whole.select("file", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("line_no", "line"))


def position(text: Column) -> Column:
    """A whole number, with commas between its digits or not; else null."""
    t = F.trim(text)
    return F.when(t.rlike("^[0-9][0-9,]*$"), F.try_to_number(F.regexp_replace(t, ",", ""), F.lit("999999999999")).cast("long"))


def number(text: Column) -> Column:
    """A decimal number, with a decimal comma or point."""
    t = F.replace(F.trim(text), F.lit(","), F.lit("."))
    return F.when(t.rlike("^[+-]?[0-9]*\\.?[0-9]+([eE][+-]?[0-9]+)?$"), t.cast("double"))


def copies_of(text: Column) -> Column:
    """Copies after an x, as in x1 or x3."""
    n = F.regexp_extract(text, "(?i)(?:^|[^a-z])x([0-9]+)(?:~[0-9]+)?(?![a-z0-9])", 1)
    return F.when(n != "", n.cast("int"))


def is_loh(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike("\\b(loh|roh|aoh|upd)\\b|copy.?neutral"), F.lit(False))


def fields(line: Column) -> Column:
    """Cells between tabs where there are three or more, else between runs of white space."""
    return F.when(F.size(F.split(line, "\t")) >= 3, F.split(line, "\t")).otherwise(F.split(F.trim(line), "\\s+"))


def _ends(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.withColumns({"s": F.least(a, b), "e": F.greatest(a, b), "swapped": F.coalesce(F.col(b) < F.col(a), F.lit(False))})


def bed_calls(lines: DataFrame) -> DataFrame:
    """Calls of typed BED lines: (file, line_no, chrom, s, e, kind, copies, name, reject), 1-based inclusive. reject says why a line is none."""
    real = lines.where("trim(line) <> '' and not line rlike '(?i)^(track|browser|#)'").withColumn("_f", fields(F.col("line")))
    df = real.select("file", "line_no", chromosome(F.get("_f", F.lit(0))).alias("chrom"), position(F.get("_f", F.lit(1))).alias("_a"), position(F.get("_f", F.lit(2))).alias("_b"), F.trim(F.coalesce(F.get("_f", F.lit(3)), F.lit(""))).alias("name"), F.concat_ws(" ", F.slice("_f", 4, 100)).alias("_text"))
    df = _ends(df, "_a", "_b").withColumns({"copies": copies_of(F.col("name"))})
    kind = F.coalesce(kind_of_text(F.col("_text")), F.when(F.col("copies") < 2, "loss").when(F.col("copies").isNotNull(), "gain"))
    reject = (
        F.when(F.col("chrom") == "chrM", "chrM")
        .when(F.col("chrom").isNull() | F.col("_a").isNull() | F.col("_b").isNull() | (F.col("s") == F.col("e")), "no position")
        .when(is_loh(F.col("name")), "copy neutral")
        .when(kind.isNull(), "no type")
    )
    return df.select("file", "line_no", "chrom", (F.col("s") + 1).alias("s"), "e", kind.alias("kind"), "copies", "name", "swapped", reject.alias("reject"))


def vcf_calls(lines: DataFrame) -> DataFrame:
    """Losses and gains of structural-variant VCF records, first sample, 1-based inclusive."""
    records = lines.where("trim(line) <> '' and not startswith(line, '#')").withColumn("_f", F.split("line", "\t"))
    get = lambda i: F.get("_f", F.lit(i))
    info = F.str_to_map(F.coalesce(get(7), F.lit("")), F.lit(";"), F.lit("="))
    sample = F.map_from_arrays(F.split(F.coalesce(get(8), F.lit("")), ":"), F.split(F.coalesce(get(9), F.lit("")), ":"))
    sizes = F.size(F.split(F.coalesce(get(8), F.lit("")), ":")) == F.size(F.split(F.coalesce(get(9), F.lit("")), ":"))
    df = records.withColumns({"_i": info, "_s": F.when(sizes, sample)})
    value = lambda m, k: F.try_element_at(m, F.lit(k))
    alt = F.coalesce(get(4), F.lit(""))
    kind_text = F.upper(F.coalesce(value("_i", "SVTYPE"), F.regexp_extract(alt, "(?i)^<([A-Z0-9]+)", 1)))
    cn_text = F.coalesce(value("_s", "CN"), value("_i", "CN"), F.nullif(F.regexp_extract(alt, "(?i)^<CN([0-9]+)>$", 1), F.lit("")))
    df = df.withColumns({"_type": kind_text, "copies": F.when(cn_text.rlike("^[0-9]+(\\.[0-9]+)?$"), F.floor(cn_text.cast("double") + 0.5).cast("int")), "_gt": F.coalesce(value("_s", "GT"), F.lit("")), "chrom": chromosome(get(0))})
    pos = F.when(F.trim(get(1)).rlike("^[0-9]+$"), get(1).cast("long"))
    length = F.abs(value("_i", "SVLEN").try_cast("long"))
    end = F.coalesce(F.when(value("_i", "END").try_cast("long") > 0, value("_i", "END").try_cast("long")), F.when(length > 0, pos + length))
    is_cnv = (F.col("_type") == "CNV") | F.col("_type").rlike("^CN[0-9]+$")
    kind = F.when(F.col("_type").rlike("^(DEL|LOSS)"), "loss").when(F.col("_type").rlike("^(DUP|GAIN|AMP)"), "gain").when(is_cnv & (F.col("copies") < 2), "loss").when(is_cnv & (F.col("copies") > 2), "gain")
    df = df.withColumns({"_pos": pos, "e": end, "kind": kind})
    reject = (
        F.when(F.size("_f") < 8, "columns")
        .when(F.col("chrom") == "chrM", "chrM")
        .when(F.col("_gt").rlike("^0([/|]0)*$"), "not carried")
        .when(is_cnv & F.col("copies").isNull(), "no copy number")
        .when(is_cnv & (F.col("copies") == 2), "copy number 2")
        .when(F.col("kind").isNull(), "type")
        .when(F.col("chrom").isNull() | F.col("_pos").isNull() | F.col("e").isNull() | (F.col("e") < F.col("_pos")), "no position")
    )
    start = F.when(F.col("e") > F.col("_pos"), F.col("_pos") + 1).otherwise(F.col("_pos"))
    return df.select("file", "line_no", "chrom", start.alias("s"), "e", "kind", "copies", F.coalesce(F.try_url_decode(value("_i", "CGH_CLASS")), F.lit("")).alias("classification"), F.coalesce(F.try_url_decode(value("_i", "CGH_NOTE")), F.lit("")).alias("note"), reject.alias("reject"))


#: Names of columns, by what they hold.
COLUMNS = {
    "chrom": ["chromosome", "chr", "chrom"],
    "start": ["start"],
    "end": ["stop", "end"],
    "type": ["type", "call", "event"],
    "copies": ["copy number", "copies", "cn"],
    "log_ratio": ["log ratio", "log2 ratio", "mean log ratio", "logratio"],
    "probes": ["#probes", "probes", "number of probes"],
    "sample": ["sample", "sample name"],
}


def interval_calls(lines: DataFrame) -> DataFrame:
    """Calls of tab-separated tables with a header row of Chromosome, Start and Stop: the columns are found by name in each file, and joined to its rows."""
    cells = F.transform(F.split("line", "\t"), lambda c: F.lower(F.trim(c)))
    named = lambda k: F.array(*[F.lit(n) for n in COLUMNS[k]])
    heads = lines.withColumn("_c", cells).where(F.array_contains("_c", "chromosome") & F.array_contains("_c", "start") & (F.array_contains("_c", "stop") | F.array_contains("_c", "end")))
    first = heads.groupBy("file").agg(F.min(F.struct("line_no", "_c")).alias("_h"))
    index = {k: F.array_min(F.filter(F.transform(named(k), lambda n: F.array_position(F.col("_h._c"), n)), lambda i: i > 0)) for k in COLUMNS}
    head = first.select("file", F.col("_h.line_no").alias("_head"), *[i.alias(f"_at_{k}") for k, i in index.items()])
    rows = lines.join(head, "file").where("line_no > _head and trim(line) <> ''").withColumn("_f", F.split("line", "\t"))
    cell = lambda k: F.trim(F.get("_f", (F.col(f"_at_{k}") - 1).cast("int")))
    rows = rows.where(~((F.size(F.filter("_f", lambda c: F.trim(c) != "")) == 1) & F.col("line").rlike("^\\s*[^\\t=]+?\\s*=\\s*[0-9]+\\s*$")) & ~F.col("line").rlike("(?i)^number of calls"))
    df = rows.select("file", "line_no", chromosome(cell("chrom")).alias("chrom"), position(cell("start")).alias("_a"), position(cell("end")).alias("_b"), F.coalesce(cell("type"), F.lit("")).alias("type_text"), position(cell("copies")).cast("int").alias("copies"), number(cell("log_ratio")).alias("log_ratio"), position(cell("probes")).alias("probes"), cell("sample").alias("sample"))
    df = _ends(df, "_a", "_b")
    kind = F.coalesce(
        kind_of_text(F.col("type_text")), F.when(F.col("copies") < 2, "loss").when(F.col("copies").isNotNull(), "gain"), F.when(F.col("log_ratio") < 0, "loss").when(F.col("log_ratio").isNotNull(), "gain")
    )
    reject = (
        F.when(F.col("chrom") == "chrM", "chrM")
        .when(F.col("chrom").isNull() | F.col("_a").isNull() | F.col("_b").isNull(), "no position")
        .when(is_loh(F.col("type_text")), "copy neutral")
        .when(kind.isNull(), "no type")
    )
    return df.select("file", "line_no", "sample", "chrom", "s", "e", kind.alias("kind"), "copies", "log_ratio", "probes", "swapped", reject.alias("reject"))


def read(calls: DataFrame) -> DataFrame:
    return calls.where("reject is null").drop("reject")


def rejects(calls: DataFrame) -> DataFrame:
    return calls.where("reject is not null").select("file", "line_no", "reject")


def benign_list(lines: DataFrame) -> DataFrame:
    """(chrom, ls, le, name, type) of a list of benign regions: 1-based inclusive; loss, gain or both by the name."""
    real = lines.where("trim(line) <> '' and not trim(line) rlike '(?i)^(track|browser|#)'").withColumn("_f", F.when(F.contains("line", F.lit("\t")), F.split("line", "\t")).otherwise(F.split(F.trim("line"), "\\s+")))
    df = real.select(chromosome(F.get("_f", F.lit(0))).alias("chrom"), position(F.get("_f", F.lit(1))).alias("_a"), position(F.get("_f", F.lit(2))).alias("_b"), F.trim(F.coalesce(F.get("_f", F.lit(3)), F.lit(""))).alias("name"))
    good = _ends(df, "_a", "_b").where("chrom is not null and s < e")
    return good.select("chrom", (F.col("s") + 1).alias("ls"), F.col("e").alias("le"), "name", F.coalesce(kind_of_text(F.col("name")), F.lit("both")).alias("type"))


def domains(lines: DataFrame) -> DataFrame:
    """(chrom, s, e, name) of a BED of domains, 0-based."""
    f = F.split("line", "\t")
    df = lines.where("trim(line) <> '' and not line rlike '^(track|browser|#)'").select(chromosome(F.get(f, F.lit(0))).alias("chrom"), position(F.get(f, F.lit(1))).alias("s"), position(F.get(f, F.lit(2))).alias("e"), F.trim(F.coalesce(F.get(f, F.lit(3)), F.lit(""))).alias("name"))
    return df.where("chrom is not null and s < e")


def panel(lines: DataFrame) -> DataFrame:
    """Distinct gene symbols of a panel: the first cell of each line, or a list between commas, semicolons and spaces."""
    symbol = F.explode(F.split(F.when(F.contains("line", F.lit("\t")), F.get(F.split("line", "\t"), F.lit(0))).otherwise(F.col("line")), "[,;\\s]+"))
    df = lines.where("not startswith(line, '#')").select(symbol.alias("gene")).select(F.upper(F.trim("gene")).alias("gene"))
    return df.where("gene rlike '^[A-Z0-9][A-Z0-9@._-]{1,24}$' and gene not in ('GENE', 'SYMBOL')").distinct()


SESSION = "version int, build string, folder string, samples array<struct<name:string,file:string,type:string>>"


def sessions(texts: DataFrame) -> DataFrame:
    """Saved sessions (text: JSON), one row a sample, matched later by file name. Newer versions than 1 are refused: their rows have a null name."""
    df = texts.select(F.from_json("text", SESSION).alias("j")).select("j.*")
    return df.select("version", "build", F.explode_outer(F.when(F.col("version") <= 1, F.col("samples"))).alias("x")).select("version", "build", "x.name", "x.file", "x.type")


def classified_lines(lines: DataFrame, classes: DataFrame, vcf: bool = False) -> DataFrame:
    """Lines written back with the class and note given to their calls (file, line_no, class, note): two last cells, or INFO entries of a VCF, percent-encoded. Other lines stay."""
    j = lines.join(classes, ["file", "line_no"], "left")
    has = F.coalesce(F.col("class"), F.lit("")) != ""
    if vcf:
        f = F.split("line", "\t")
        entry = F.concat(F.lit(";CGH_CLASS="), F.url_encode("class"), F.when(F.coalesce(F.col("note"), F.lit("")) != "", F.concat(F.lit(";CGH_NOTE="), F.url_encode("note"))).otherwise(F.lit("")))
        clean = F.regexp_replace(F.get(f, F.lit(7)), ";?CGH_(CLASS|NOTE)=[^;]*", "")
        new = F.array_join(F.transform(f, lambda c, i: F.when(i == 7, F.concat(clean, entry)).otherwise(c)), "\t")
    else:
        new = F.concat_ws("\t", "line", "class", F.coalesce("note", F.lit("")))
    return j.select("file", "line_no", F.when(has, new).otherwise(F.col("line")).alias("line"))


def numbered(lines: DataFrame) -> DataFrame:
    """Lines in order, for writers: one row a file with its text. A file's lines are one patient's."""
    w = Window.partitionBy("file")
    return lines.withColumn("_n", F.count(F.lit(1)).over(w)).groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))


def records(text: Column) -> Column:
    """Records of a delimited text, as an array: line ends inside double quotes belong to their record; records without a character are left out."""
    return F.regexp_extract_all(F.regexp_replace(text, "\r\n?", "\n"), F.lit('((?:"(?:[^"]|"")*"|[^"\n])+)'), F.lit(1))


def cells(record: Column, delimiter: str = ",") -> Column:
    """Cells of a record, without the quotes around them and with doubled quotes as one."""
    # a delimiter goes before the first cell too, so that every cell follows one
    found = F.regexp_extract_all(F.concat(F.lit(delimiter), record), F.lit(f'{delimiter}("(?:[^"]|"")*"|[^{delimiter}]*)'), F.lit(1))
    bare = lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    return F.transform(found, bare)
