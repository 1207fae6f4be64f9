"""Reference sequences from FASTA text, kept as tiles of one width.

The text reader itself cuts records at the marks between contigs; a record is cut into tiles at once, so that what joins a
reference, window by window, are its tiles and never a contig.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 1 << 14


def sequences(spark, path: str) -> DataFrame:
    """(contig, seq) of FASTA files: the name up to the first blank, the bases in capitals without line ends."""
    text = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    name = F.regexp_extract("value", "^[^ \\t\\r\\n]+", 0)
    body = F.regexp_replace(F.regexp_replace("value", "^[^\\n]*\\n?", ""), "\\s+", "")
    return text.select(name.alias("contig"), F.upper(body).alias("seq"))


def tiles(reference: DataFrame, width: int = TILE) -> DataFrame:
    """(contig, tile, bases) of sequences; the last tile of a contig is shorter. A contig without bases has one empty tile."""
    last = F.greatest(F.floor((F.length("seq") - 1) / width), F.lit(0)).cast("int")
    at = reference.select("contig", "seq", F.explode(F.sequence(F.lit(0), last)).alias("tile"))
    return at.select("contig", "tile", F.substring("seq", F.col("tile") * width + 1, F.lit(width)).alias("bases"))


def windows(tiled: DataFrame, asked: DataFrame, width: int = TILE) -> DataFrame:
    """asked (contig, s, e) with the reference's bases from s to e, from 0; what lies off the contig is left out, as are contigs that the reference lacks."""
    names = asked.columns
    once = asked.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    begin = F.greatest(F.col("s"), F.lit(0))
    touched = F.sequence(F.floor(begin / width).cast("int"), F.floor((F.greatest(F.col("e"), begin + 1) - 1) / width).cast("int"))
    hit = once.withColumn("tile", F.explode(touched)).join(tiled.select("contig", "tile", "bases"), ["contig", "tile"], "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("bases").isNotNull(), F.struct("tile", "bases")))), lambda t: t["bases"]), "")
    whole = hit.groupBy(*names, "_n").agg(text.alias("_text"))
    cut = F.substring("_text", (begin % width + 1).cast("int"), F.greatest(F.col("e") - begin, F.lit(0)).cast("int"))
    known = tiled.where("tile = 0").select("contig")
    return whole.join(known, "contig", "left_semi").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select(*names, cut.alias("bases"))
