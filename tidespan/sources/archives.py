"""Files as they are dropped: zip entries, gzip, text in whatever encoding, first sheets of workbooks, data files and their indexes. Files are one patient's tables, so one task reads a file whole."""

from __future__ import annotations

import gzip
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def files(spark, path: str) -> DataFrame:
    """(path, content) of the files at a path, in any store that Spark reads. A file without a byte gives no row."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def is_workbook(z: zipfile.ZipFile) -> bool:
    return "xl/workbook.xml" in z.namelist()


def unpacked(name: str, content: bytes, nested: bool = True) -> Iterator[tuple[str, bytes]]:
    """Entries of a zip, of zips in it one level down, and the content of a gzip; a workbook and anything else stays as it is."""
    if content[:2] == b"\x1f\x8b":
        yield re.sub(r"(?i)\.gz$", "", name), gzip.decompress(content)
    elif content[:4] == b"PK\x03\x04" and not is_workbook(z := zipfile.ZipFile(io.BytesIO(content))):
        for info in z.infolist():
            if not info.is_dir():
                inner = z.read(info)
                yield from unpacked(info.filename, inner, False) if nested else [(info.filename, inner)]
    else:
        yield name, content


def entries(content: DataFrame) -> DataFrame:
    """(path, entry, content) of files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, body in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                found = list(unpacked(posixpath.basename(path), body or b""))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array([n for n, _ in found], pa.string()), pa.array([c for _, c in found], pa.binary())], names=["path", "entry", "content"])

    return content.select("path", "content").mapInArrow(run, "path string, entry string, content binary")


def decoded(content: bytes) -> str:
    """Text by its byte order mark, else UTF-8, else Windows-1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if content.startswith(mark):
            return content[len(mark) :].decode(name, "replace")
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("cp1252", "replace")


def lines(content: DataFrame) -> DataFrame:
    """(path, entry, line_no, line) of entries that are text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decoded(c or b"") for c in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("entry"), pa.array(texts, pa.string())], names=["path", "entry", "text"])

    texts = content.select("path", "entry", "content").mapInArrow(run, "path string, entry string, text string")
    return texts.select("path", "entry", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("line_no", "line"))


def column_number(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n


def first_sheet(content: bytes) -> list[tuple[int, list[str]]]:
    """(row number, cells) of a workbook's first sheet; cells that are left out are empty."""
    z = zipfile.ZipFile(io.BytesIO(content))
    xml = lambda name: ElementTree.fromstring(z.read(name))
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{MAIN}t"))
    sheet = next(xml("xl/workbook.xml").iter(f"{MAIN}sheet"))
    target = next(r.get("Target") for r in xml("xl/_rels/workbook.xml.rels") if r.get("Id") == sheet.get(RELATION))
    shared = [text(si) for si in xml("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
    out = []
    for i, row in enumerate(xml(posixpath.normpath(posixpath.join("/xl", target)).lstrip("/")).iter(f"{MAIN}row"), 1):
        cells: list[str] = []
        for c in row.iter(f"{MAIN}c"):
            at = column_number(c.get("r", "")) or len(cells) + 1
            cells += [""] * (at - 1 - len(cells))
            v = c.find(f"{MAIN}v")
            value = "" if v is None else v.text or ""
            cells.append(shared[int(value)] if c.get("t") == "s" and value else text(c) if c.get("t") == "inlineStr" else value)
        out.append((int(row.get("r") or i), cells))
    return out


def sheet_rows(content: DataFrame) -> DataFrame:
    """(path, entry, row_no, cells) of the first sheets of workbooks among entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, entry, body in zip(*(b.column(c).to_pylist() for c in ("path", "entry", "content")), strict=True):
                rows = first_sheet(body) if (body or b"")[:4] == b"PK\x03\x04" else []
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([entry] * len(rows), pa.string()), pa.array([r for r, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.list_(pa.string()))], names=["path", "entry", "row_no", "cells"])

    return content.select("path", "entry", "content").mapInArrow(run, "path string, entry string, row_no int, cells array<string>")


def with_index(paths: DataFrame) -> DataFrame:
    """(data, index) of alignment files and the index beside each, by its whole name or the name without the ending, whatever the case; null where there is none."""
    low = F.lower("path")
    data = paths.where(low.rlike("\\.(bam|cram)$")).select(F.col("path").alias("data"), low.alias("_name"))
    ending: Column = F.when(low.endswith(".crai"), ".cram").otherwise(".bam")
    bare = F.regexp_replace(low, "\\.(bai|csi|crai)$", "")
    index = paths.where(low.rlike("\\.(bai|csi|crai)$")).select(F.col("path").alias("index"), F.when(bare.rlike("\\.(bam|cram)$"), bare).otherwise(F.concat(bare, ending)).alias("_name"), bare.rlike("\\.(bam|cram)$").alias("_whole"))
    best = index.groupBy("_name").agg(F.min(F.struct((~F.col("_whole")).alias("k"), "index")).alias("_i"))
    return data.join(best, "_name", "left").select("data", F.col("_i.index").alias("index"))
