"""Kinds of input: a name, a test of a path, and readers of the tables it holds. Later registrations win."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FileKind:
    name: str
    accepts: Callable[[str], bool]
    tables: dict = field(default_factory=dict)  # table name -> function of (spark, path)
    endings: tuple[str, ...] = ()  # of the paths it accepts, in lower case, where endings decide


_KINDS: list[FileKind] = []


def register(kind: FileKind) -> None:
    _KINDS[:] = [k for k in _KINDS if k.name != kind.name]
    _KINDS.insert(0, kind)


def kind_of(path: str) -> FileKind | None:
    return next((k for k in _KINDS if k.accepts(path)), None)


def by_ending(name: str, endings: tuple[str, ...], tables: dict) -> FileKind:
    return FileKind(name, lambda p: p.lower().endswith(endings), tables, endings)


def kind_column(path: Column) -> Column:
    """The kind of each path, of those kinds that go by endings; null for others."""
    out = F.lit(None).cast("string")
    for k in reversed(_KINDS):
        for ending in k.endings:
            out = F.when(F.lower(path).endswith(ending), k.name).otherwise(out)
    return out


def open_table(spark, path: str, table: str):
    kind = kind_of(path)
    if kind is None or table not in kind.tables:
        raise ValueError(f"no reader of {table} for {path}")
    return kind.tables[table](spark, path)


def _defaults() -> None:
    from tidespan.sources import tables as t

    register(by_ending("parquet", (".parquet",), {"rows": lambda s, p: s.read.parquet(p)}))
    register(by_ending("interval", (".txt", ".tsv"), {"calls": lambda s, p: t.interval_calls(t.lines_of(s, p))}))
    register(by_ending("bed", (".bed",), {"calls": lambda s, p: t.bed_calls(t.lines_of(s, p)), "benign": lambda s, p: t.benign_list(t.lines_of(s, p)), "domains": lambda s, p: t.domains(t.lines_of(s, p))}))
    register(by_ending("vcf", (".vcf", ".vcf.gz"), {"calls": lambda s, p: t.vcf_calls(t.lines_of(s, p))}))


_defaults()
