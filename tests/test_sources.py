"""Archives, workbooks, encodings, indexes, FASTA files and exact groups of fragments."""

import gzip
import io
import random
import zipfile

from tidespan.operators import consensus
from tidespan.sources import archives, fasta, tables


def zipped(items):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in items:
            z.writestr(name, body)
    return out.getvalue()


def test_entries_and_encodings(spark, tmp_path):
    inner = zipped([("deep.txt", "déjà".encode("cp1252")), ("deeper.zip", zipped([("x", b"1")]))])
    (tmp_path / "a.zip").write_bytes(zipped([("one.txt", "﻿ü".encode()), ("two.txt", "ü\nz".encode("utf-16")), ("inner.zip", inner)]))
    (tmp_path / "b.tsv.gz").write_bytes(gzip.compress(b"q\r\nr"))
    e = archives.entries(archives.files(spark, str(tmp_path)))
    got = {r["entry"]: bytes(r["content"]) for r in e.collect()}
    assert set(got) == {"one.txt", "two.txt", "deep.txt", "deeper.zip", "b.tsv"}
    x = {}
    for r in archives.lines(e.where("entry <> 'deeper.zip'")).collect():
        x.setdefault(r["entry"], {})[r["line_no"]] = r["line"]
    assert x == {"one.txt": {0: "ü"}, "two.txt": {0: "ü", 1: "z"}, "deep.txt": {0: "déjà"}, "b.tsv": {0: "q", 1: "r"}}
    assert [archives.column_number(c) for c in ("A1", "Z9", "AA3", "BC7")] == [1, 26, 27, 55]


def test_index_files(spark):
    paths = ["/a/x.bam", "/a/X.bam.bai", "/a/x.bai", "/b/x.bam", "/a/y.cram", "/a/y.crai", "/a/z.txt"]
    got = archives.with_index(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert {r["data"]: r["index"] for r in got} == {"/a/x.bam": "/a/X.bam.bai", "/b/x.bam": None, "/a/y.cram": "/a/y.crai"}


def test_fasta(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">one first\nacgt\nACGT\n\n>two\r\nNNac\r\n>none\n")
    ref = fasta.sequences(spark, str(tmp_path / "r.fa"))
    assert {r["contig"]: r["seq"] for r in ref.collect()} == {"one": "ACGTACGT", "two": "NNAC", "none": ""}
    asked = spark.createDataFrame([("one", 2, 5), ("one", -3, 2), ("two", 3, 99), ("gone", 0, 1)], "contig string, s int, e int")
    for width in (1, 2, 3, 1000):
        tiled = fasta.tiles(ref, width)
        assert sorted((r["contig"], r["s"], r["bases"]) for r in fasta.windows(tiled, asked.union(asked), width).collect()) == sorted(2 * [("one", -3, "AC"), ("one", 2, "GTA"), ("two", 3, "C")])


def test_records(spark):
    from pyspark.sql import functions as F

    text = 'a,"b ""c"", d",\r\n"x\ny",,z\n\n"",1'
    got = spark.createDataFrame([(text,)], "t string").select(F.explode(tables.records(F.col("t"))).alias("r")).select(tables.cells(F.col("r")).alias("c")).collect()
    assert [r["c"] for r in got] == [["a", 'b "c", d', ""], ["x\ny", "", "z"], ["", "1"]]


def test_exact_groups(spark):
    rng = random.Random(14)
    rows = []
    for i in range(160):
        s = rng.choice([0, 40, 400])
        joined = rng.random() < 0.5
        blocks = [(s, s + 50), (s + 70, s + 120)] if joined else [(s, s + rng.choice([50, 100]))]
        alleles = {p: rng.choice("AC") for p in (s + 10, s + 90) if rng.random() < 0.4}
        rows.append((i, blocks, [(s + 50, s + 70)] if joined else [], alleles))
    # by the rules, one step after another
    patterns = {}
    for i, b, j, a in rows:
        patterns.setdefault((tuple(j), tuple(sorted(a.items()))), []).append((i, b))
    order = sorted(patterns, key=lambda k: (-len(k[0]) - len(k[1]), -len(patterns[k]), patterns[k][0][0]))

    def fits(g, h):
        mine, other = ([x for _, bs in patterns[k] for x in bs] for k in (g, h))
        if max(e for _, e in mine) <= min(s for s, _ in other) or max(e for _, e in other) <= min(s for s, _ in mine):
            return False
        across = any(s < je and js < e for js, je in h[0] for s, e in mine)
        return set(g[0]) <= set(h[0]) and not across and all(dict(h[1]).get(p) == x for p, x in g[1])

    seeds = []
    for k in order:
        if len(patterns[k]) >= 3 and not any(fits(k, x) for x in seeds):
            seeds.append(k)
    while True:
        hits = {k: [x for x in seeds if fits(k, x)] for k in order}
        weak = [x for x in seeds if sum(len(patterns[k]) for k in order if hits[k] == [x]) < 3]
        if not weak:
            break
        seeds = [x for x in seeds if x not in weak]
    want = {i: ("minor" if not hits[k] else "member" if len(hits[k]) == 1 else "ambiguous", patterns[hits[k][0]][0][0] if len(hits[k]) == 1 else None) for k in order for i, _ in patterns[k]}
    df = spark.createDataFrame([("c", i, b, j, a) for i, b, j, a in rows], "locus string, id long, blocks array<struct<s:int,e:int>>, junctions array<struct<s:int,e:int>>, alleles map<int,string>")
    got = {r["id"]: (r["status"], r["anchor"]) for r in consensus.exact_groups(df, "locus").collect()}
    assert got == want and len({v[0] for v in want.values()}) == 3


def test_flanks():
    from tidespan.operators import flanks

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return row[-1]

    rng = random.Random(16)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    for _ in range(60):
        a, b = dna(rng.randint(0, 9)), dna(rng.randint(0, 9))
        if rng.random() < 0.5:
            b = a[rng.randint(0, 3) :] + dna(2)
        at_end = rng.random() < 0.5
        ref, own = flanks.aligned(b, a, at_end)
        assert ref.replace("-", "").strip() == a and own.replace("-", "").strip() == b and len(ref) == len(own)
        x, y = (a[::-1], b[::-1]) if at_end else (a, b)
        least = min([edits(x, y[:j]) for j in range(len(y) + 1)] + [edits(x[:i], y) for i in range(len(x) + 1)])
        r, o = (ref[::-1], own[::-1]) if at_end else (ref, own)
        # up to the free end, where one of them is whole, there are as few edits as can be
        costs = [sum(p != q for p, q in zip(r[:k], o[:k])) for k in range(len(r) + 1) if r[:k].replace("-", "") == x or o[:k].replace("-", "") == y]
        assert min(costs) == least, (a, b, ref, own)


def test_columns_of_reads(spark, tmp_path):
    from tidespan.sources import columnar

    rng = random.Random(17)
    rows = [(rng.choice("ab"), s, s + rng.choice([1, 30, 800])) for s in rng.choices(range(5000), k=400)]
    df = spark.createDataFrame(rows, "contig string, s int, e int")
    columnar.write_reads(df, f"{tmp_path}/x")
    got = columnar.read_range(spark, f"{tmp_path}/x", "a", 1000, 1200)
    assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[0] == "a" and r[1] < 1200 and r[2] > 1000)
    assert columnar.read_range(spark, f"{tmp_path}/x", "c", 0, 9).count() == 0
    runs = spark.createDataFrame([("a", 0, 5, 2), ("a", 5, 9, 3), ("a", 20, 9000, 1), ("a", 9000, 9001, 4), ("b", 7, 8, 1)], "contig string, s int, e int, depth long")
    back = columnar.decoded_runs(columnar.encoded_runs(runs, ["contig"]), ["contig"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, runs.collect()))


def test_exact_groups_without_seeds(spark):
    schema = "locus string, id long, blocks array<struct<s:int,e:int>>, junctions array<struct<s:int,e:int>>, alleles map<int,string>"
    rows = [("c", 1, [(0, 9)], [], {3: "A"}), ("c", 2, [(0, 9)], [], {3: "C"}), ("d", 3, [(0, 9)], None, None)]
    got = consensus.exact_groups(spark.createDataFrame(rows, schema), "locus").collect()
    assert sorted((r["id"], r["status"], r["anchor"]) for r in got) == [(1, "minor", None), (2, "minor", None), (3, "minor", None)]
    assert consensus.exact_groups(spark.createDataFrame([], schema), "locus").count() == 0
