"""Operators whose result depends on order, and string operators, against plain loops on random input."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tidespan.operators import consequence, evidence, junctions, placement


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def half_weight(pairs):
    pairs, total = sorted(pairs), sum(w for _, w in pairs)
    at = 0
    for x, w in pairs:
        at += w
        if 2 * at >= total:
            return x


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_snapped(spark, seed):
    rng = random.Random(seed)
    rows = {(c, rng.randrange(60), 100 + rng.randrange(60)): rng.choice([1, 2, 5, 30, 45, 700, 900, 20_000]) for _ in range(250) for c in "ab"}
    want = {}
    for c in "ab":
        own = sorted(((s, e, n) for (k, s, e), n in rows.items() if k == c), key=lambda r: (-r[2], r[0], r[1]))
        for i, (s, e, n) in enumerate(own):
            if (c, s, e) in want:
                continue
            want[c, s, e] = (s, e)
            for s2, e2, n2 in own[i + 1 :]:
                if (c, s2, e2) not in want and abs(s - s2) <= 6 and abs(e - e2) <= 6 and 20 * n2 <= n:
                    want[c, s2, e2] = (s, e)
    got = junctions.snapped(frame(spark, [(*k, n) for k, n in rows.items()], "contig string, s int, e int, n long"), "contig").collect()
    assert {(r["contig"], r["s"], r["e"]): (r["to_s"], r["to_e"]) for r in got} == want
    assert len({v for v in want.values()}) < len(want)


def test_nested(spark):
    rng = random.Random(4)
    rows = list({(c, s, s + rng.randint(1, 40)) for c in "ab" for s in rng.choices(range(400), k=150)})
    want = {}
    for c, s, e in sorted(rows, key=lambda r: (r[2] - r[1], r[1])):
        want[c, s, e] = 1 + max([0] + [v for (c2, s2, e2), v in want.items() if c2 == c and s2 < e and s < e2])
    got = junctions.nested(frame(spark, rows, "contig string, s int, e int"), "contig").collect()
    assert {(r["contig"], r["s"], r["e"]): r["level"] for r in got} == want


@pytest.mark.parametrize("seed", [5, 6])
def test_events(spark, seed):
    rng = random.Random(seed)
    rows = list({(c, s, s + rng.choice([30, 400, 1500, 1520])): rng.randint(1, 9) for c in "ab" for s in rng.choices(range(6000), k=200)}.items())
    rows = [(*k, n) for k, n in rows]
    tol = lambda n: min(100, max(20, math.floor(0.05 * n + 0.5)))
    want = Counter()
    for c in "ab":
        made = []
        for s, e, n in sorted((s, e, n) for k, s, e, n in rows if k == c):
            best = None
            for g in made:
                w = sum(m[2] for m in g)
                cs, ce = (sum(m[i] * m[2] for m in g) / w for i in (0, 1))
                if all(max(abs(m[0] - s), abs(m[1] - e)) <= min(tol(e - s), tol(ce - cs)) for m in g):
                    far = abs(cs - s) + abs(ce - e)
                    if best is None or far <= best[0] + 1e-9:
                        best = (far, g)
            if best:
                best[1].append((s, e, n))
            else:
                made.append([(s, e, n)])
        for g in made:
            s, e = half_weight([(m[0], m[2]) for m in g]), half_weight([(m[1], m[2]) for m in g])
            want[c, s, max(e, s + 1), sum(m[2] for m in g), len(g)] += 1
    got = evidence.clustered(frame(spark, rows, "contig string, s int, e int, n long"), "contig").collect()
    assert Counter((r["contig"], r["s"], r["e"], r["count"], r["merged"]) for r in got) == want

    ends = list({(c, rng.randrange(9000)): rng.randint(1, 9) for c in "ab" for _ in range(150)}.items())
    near = {}
    for c in "ab":
        group = []
        for p, n in [*sorted((k[1], n) for k, n in ends if k[0] == c), (10**9, 1)]:
            if group and p - group[0][0] > 100:
                near |= {(c, q): half_weight(group) for q, _ in group}
                group = []
            group.append((p, n))
    got = evidence.breakends(frame(spark, [(*k, n) for k, n in ends], "contig string, pos int, n long"), "contig").collect()
    assert {(r["contig"], r["pos"]): r["to"] for r in got} == near


def test_pairs_and_rows(spark):
    rng = random.Random(7)
    keys = {(rng.choice(["deletion", "duplication", "inversion"]), rng.randrange(9000), 20_000 + rng.randrange(9000)): rng.randint(1, 6) for _ in range(150)}
    made = []
    for (kind, s, e), n in sorted(keys.items(), key=lambda x: (-x[1], x[0][1], x[0][2], x[0][0])):
        g = next((g for g in made if g[0] == kind and abs(g[1] - s) <= 1000 and abs(g[2] - e) <= 1000), None)
        if g is None:
            made.append([kind, s, e, n])
            continue
        g[3] += n
        if kind == "duplication":
            g[1], g[2] = min(g[1], s), max(g[2], e)
        elif kind == "deletion" and max(g[1], s) < min(g[2], e):
            g[1], g[2] = max(g[1], s), min(g[2], e)
    got = evidence.pooled_pairs(frame(spark, [("c", *k, n) for k, n in keys.items()], "contig string, kind string, s int, e int, n long"), "contig").collect()
    assert sorted((r["kind"], r["s"], r["e"], r["count"]) for r in got) == sorted(map(tuple, made))


def test_mates_of_random_reads(spark):
    rng = random.Random(8)
    rows = [("c", i, rng.choice("abcdef"), rng.choice([10, 20, 30]), rng.choice([10, 20, 30, None]), rng.choice([64, 128]), rng.choice([5, -5, 9, -9, None])) for i in range(120)]
    mate = {}
    rules = (lambda r, m: r[2] == m[2], lambda r, m: (m[6] or 0) == -(r[6] or 0), lambda r, m: True)
    for rule in rules:
        for r in rows:
            if r[1] not in mate and r[4] is not None:
                m = next((m for m in rows if m[1] != r[1] and m[1] not in mate and m[3] == r[4] and m[4] == r[3] and m[5] != r[5] and rule(r, m)), None)
                if m:
                    mate[r[1]], mate[m[1]] = m[1], r[1]
    got = evidence.mates(frame(spark, rows, "contig string, id long, name string, s int, mate_s int, bits int, tlen int"), "contig").collect()
    assert {r["id"]: r["mate"] for r in got} == {r[1]: mate.get(r[1]) for r in rows} and len(mate) > 60


def test_allele_modes():
    rng = random.Random(9)
    for _ in range(40):
        modes = [rng.randint(8, 30), rng.randint(40, 90)][: rng.randint(1, 2)]
        u = sorted(max(1, round(rng.gauss(rng.choice(modes), 1.5))) for _ in range(rng.randint(1, 40)))
        got = evidence.allele_modes(np.array(u))
        if len(u) < 3:
            assert got == []
            continue
        x = [math.log(v) for v in u]
        mean = sum(x) / len(x)
        sd = math.sqrt(sum((v - mean) ** 2 for v in x) / len(x))
        q = lambda p: math.log(u[math.floor(p * (len(u) - 1) + 0.5)])
        iqr = (q(0.75) - q(0.25)) / 1.34
        h = max(0.04, 0.9 * min(sd, iqr or sd) * len(x) ** -0.2)
        g0, g1 = math.log(max(1, 0.8 * u[0])), math.log(1.25 * u[-1])
        grid = [g0 + 0.005 * k for k in range(int((g1 - g0) / 0.005) + 1)]
        f = [sum(math.exp(-(((g - v) / h) ** 2) / 2) for v in x if abs(g - v) < 4 * h) for g in grid]
        tops = [k for k in range(1, len(f) - 1) if f[k] >= f[k - 1] and f[k] > f[k + 1] and f[k] >= 0.15 * max(f)]
        keep = [k for k in tops if all(min(f[min(k, t) : max(k, t) + 1]) < 0.7 * f[k] for t in tops if f[t] > f[k])]
        keep = sorted(sorted(keep, key=lambda k: -f[k])[:2])
        cuts = [math.exp(grid[min(range(a, b + 1), key=lambda k: f[k])]) for a, b in zip(keep, keep[1:])]
        parts = [sum(lo < v <= hi for v in u) for lo, hi in zip([0, *cuts], [*cuts, math.inf])]
        assert [s for s, _ in got] == [math.floor(math.exp(grid[k]) + 0.5) for k in keep] and [n for _, n in got] == parts


def test_strings(spark):
    rng = random.Random(10)
    dna = lambda n, a="ACGT": "".join(rng.choice(a) for _ in range(n))
    tracts = [(i, "".join(rng.choice(["CGG", "CGG", "AGG", "T", "GG", "CGA"]) for _ in range(rng.randint(0, 12)))) for i in range(60)]

    def read(t):
        out, i = "", 0
        while i + 3 <= len(t):
            c = {"CGG": "P", "CGA": "B", "AGG": "I"}.get(t[i : i + 3])
            skip = next((j for j in (1, 2) if t[i + j : i + j + 3] in ("CGG", "CGA")), 0) if c is None else 0
            if skip:
                i += skip
            else:
                out, i = out + (c or "o"), i + 3
        return out

    from pyspark.sql import functions as F

    got = frame(spark, tracts, "id int, t string").select("id", consequence.tract_tokens(F.col("t"), ["CGG"], ["CGA"], ["AGG"], 3).alias("x")).collect()
    assert {r["id"]: r["x"] for r in got} == {i: read(t) for i, t in tracts}

    seqs = [(i, rng.choice([dna(rng.randint(0, 40)), dna(rng.randint(1, 6)) * rng.randint(2, 9), "CAG" * 8 + dna(9), dna(20, "ANA")])) for i in range(80)]

    def motif(seq):
        best = None
        for k in range(1, 7):
            if len(seq) < 3 * k:
                break
            n = Counter(min(u[r:] + u[:r] for r in range(k)) for u in (seq[i : i + k] for i in range(len(seq) - k + 1)) if "N" not in u)
            if not n:
                continue
            top = max(n, key=n.get)
            if any(k % m == 0 and top[:m] * (k // m) == top for m in range(1, k)):
                continue
            if best is None or n[top] / (len(seq) - k + 1) > best[1] + 0.05:
                best = (top, n[top] / (len(seq) - k + 1))
        return best if best and best[1] >= 0.5 else None

    got = {r["id"]: (r["motif"], round(r["share"], 9)) for r in consequence.motifs(frame(spark, seqs, "id int, seq string"), "id").collect()}
    assert got == {i: (m[0], round(m[1], 9)) for i, s in seqs if (m := motif(s))}

    pairs = []
    for i in range(80):
        a = dna(rng.randint(1, 12), "MAKL")
        p, q = rng.randint(0, len(a)), rng.randint(0, len(a))
        pairs.append((i, a, rng.choice([a, "", a[: min(p, q)] + dna(rng.randint(0, 3), "MAKL") + a[max(p, q) :]]), rng.random() < 0.7))
    got = frame(spark, pairs, "id int, a string, b string, stop boolean").select("id", consequence.protein_difference(F.col("a"), F.col("b"), F.col("stop")).alias("d")).collect()
    for i, a, b, stop in pairs:
        d = tuple(got[i]["d"])
        p = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        if not b:
            want = ("no_protein", 0, len(a), "")
        elif a == b:
            want = ("identical", p, p, "")
        elif not stop:
            want = ("frameshift" if b[p:] else "truncation", p, len(a), b[p:])
        else:
            n = 0
            while n < min(len(a), len(b)) - p and a[-1 - n] == b[-1 - n]:
                n += 1
            kind = "in_frame_indel" if len(a) - n > p and len(b) - n > p else "in_frame_deletion" if len(a) - n > p else "in_frame_insertion"
            want = (kind, p, len(a) - n, b[p : len(b) - n])
        assert d == want, (a, b, stop)


def test_places(spark):
    rng = random.Random(11)
    ref = "".join(rng.choice("ACGT") for _ in range(500))
    back = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    wrong = lambda x, *at: "".join("ACGT"["ACGT".index(c) ^ 1] if i in at else c for i, c in enumerate(x))
    clips = [(1, ref[100:140], True), (2, back(ref[200:230]), False), (3, ref[100:115], True), (4, wrong(ref[300:340], 25), True), (5, wrong(ref[300:340], 25, 30, 33), True), (6, "NN" + ref[40:80] + "N", False), (7, ref[40:60] + "N" + ref[61:80], True), (8, ref[480:500] + "ACGTAC", True), (9, ref[40:140], False)]
    rows = frame(spark, [("w", *c) for c in clips] + [("x", 1, ref[100:140], True)], "win string, clip int, seq string, right boolean")
    windows = frame(spark, [("w", 1000, ref), ("x", 0, ref + ref)], "win string, start int, seq string")
    got = {(r["win"], r["clip"]): (r["s"], r["e"], r["strand"]) for r in placement.place_clips(rows, windows, "win").collect()}
    assert got == {("w", 1): (1100, 1140, "+"), ("w", 2): (1200, 1230, "-"), ("w", 4): (1300, 1340, "+"), ("w", 6): (1040, 1080, "+"), ("w", 9): (1080, 1140, "+")}


def test_pooled_discordant(spark):
    from tidespan.operators import rearrangement

    rng = random.Random(12)
    rows = []
    for _ in range(220):
        lo = rng.randrange(6000)
        hi = lo + rng.choice([800, 3000, 3400])
        rows.append(("c", rng.choice(["deletion", "duplication", "inversion"]), lo, hi, lo + rng.randrange(100), hi - rng.randrange(100)))
    want = []
    for kind in ("deletion", "duplication", "inversion"):
        bins = {}
        for _, k, lo, hi, a, b in rows:
            if k == kind:
                bins.setdefault((lo // 500 * 500, -(-hi // 500) * 500), []).append((a, b))
        order = sorted(bins, key=lambda x: (-len(bins[x]), x))
        used = set()
        for x in order:
            if x in used:
                continue
            own = [y for y in order if y not in used and abs(x[0] - y[0]) <= 500 and abs(x[1] - y[1]) <= 500]
            used |= set(own)
            a, b = (sorted(v[i] for y in own for v in bins[y]) for i in (0, 1))
            s, e = (a[0], b[-1]) if kind == "duplication" else (a[-1], b[0]) if kind == "deletion" else (a[len(a) // 2], b[len(b) // 2])
            want.append((kind, *((s, e) if e > s else (min(y[0] for y in own), max(y[1] for y in own))), len(a)))
    got = rearrangement.pooled_discordant(frame(spark, rows, "contig string, kind string, lo int, hi int, a int, b int"), "contig").collect()
    assert sorted((r["kind"], r["s"], r["e"], r["count"]) for r in got) == sorted(want)


def test_annotations_of_another_chromosome(spark):
    from tidespan.operators import annotation, cgh

    calls = frame(spark, [(1, "chr1", "loss", 100, 200)], "call int, chrom string, kind string, s int, e int")
    for chrom, n in (("chr2", 0), ("chr1", 1)):
        lab = frame(spark, [(9, chrom, 100, 200, "loss")], "entry int, chrom string, ls int, le int, type string")
        pop = frame(spark, [(9, chrom, "loss", 100, 200, 100, 200)], "sv int, chrom string, type string, os int, oe int, is_ int, ie int")
        rec = frame(spark, [(9, chrom, 100, 200)], "region int, chrom string, rs int, re int")
        dgv = pop.withColumnRenamed("sv", "record")
        assert [x.count() for x in (cgh.lab_matches(calls, lab), cgh.population_matches(calls, pop), cgh.recurrent(calls, rec), annotation.dgv_hits(calls, dgv))] == [n] * 4


def test_merged_over_stretches(spark):
    from tidespan.operators import intervals

    rng = random.Random(13)
    rows = [("c", s, s + rng.choice([5, 300, 9000])) for s in rng.choices(range(60_000), k=60)]
    want, gap = [], 50
    for _, s, e in sorted(rows):
        if want and s <= want[-1][1] + gap:
            want[-1][1] = max(want[-1][1], e)
            want[-1][2] += 1
        else:
            want.append([s, e, 1])
    got = intervals.merged(frame(spark, rows, "contig string, s int, e int"), ["contig"], gap).collect()
    assert sorted((r["s"], r["e"], r["members"]) for r in got) == sorted(map(tuple, want))


def test_overlap_totals_and_recurrence(spark):
    from tidespan.operators import intervals

    rng = random.Random(15)
    reads = [(rng.choice("ab"), s, s + rng.choice([0, 1, 40, 5000])) for s in rng.choices(range(12_000), k=300)]
    genes = [(i, rng.choice("abc"), s, s + rng.choice([0, 1, 300, 9000])) for i, s in enumerate(rng.choices(range(-50, 13_000), k=80))]
    want = {}
    for i, c, a, b in genes:
        x = [min(e, b) - max(s, a) for k, s, e in reads if k == c and s < e and a < b and s < b and a < e]
        if x:
            want[i] = (len(x), sum(x))
    got = intervals.overlap_totals(frame(spark, genes, "gene int, contig string, gs int, ge int"), frame(spark, reads, "contig string, s int, e int"), ["contig"], ("gs", "ge")).collect()
    assert {r["gene"]: (r["n"], r["bases"]) for r in got} == want
    calls = [(i, rng.randrange(12), "1", rng.choice(["loss", "gain"]), s, s + rng.choice([0, 1, 2, 9, 70, 100, 140, 900])) for i, s in enumerate(rng.choices(range(400), k=250))]
    best = {}
    for i, p, _, k, s, e in calls:
        for _, q, _, k2, s2, e2 in calls:
            ro = (min(e, e2) - max(s, s2) + 1) / max(e - s + 1, e2 - s2 + 1)
            if p != q and k == k2 and ro >= 0.7:
                best[i, q] = max(best.get((i, q), 0), ro)
    got = intervals.recurrence(frame(spark, calls, "call int, patient int, chrom string, kind string, s int, e int")).collect()
    assert {(r["call"], r["other"]): r["pct"] for r in got} == {k: math.floor(100 * v + 0.5) for k, v in best.items()}
