"""Operators of the third round against plain loops on random input: clusters, rescue, event shares, variants, streams, joints, chains, repeats, notation."""

import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidespan.functions.reads import cigar_ops
from tidespan.operators import alignment, derivatives, events, joints, notation, repeats, rescue, tolerant, variants


def turn(x):
    return x[::-1].translate(str.maketrans("ACGTN", "TGCAN"))


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def tiles_of(spark, refs, width):
    rows = [(c, k // width, s[k : k + width]) for c, s in refs.items() for k in range(0, len(s), width)]
    return spark.createDataFrame(rows, "contig string, tile int, seq string")


# ---- clusters with tolerance -----------------------------------------------------------------------------------------


class Plain:
    """A group of fragments as sets of positions: the rules once more, without any index."""

    def __init__(self, covered, junctions, calls):
        self.covered, self.junctions, self.calls = set(covered), set(junctions), dict(calls)
        self.votes, self.members, self.n = defaultdict(lambda: defaultdict(int)), [], 0

    def meets(self, o):
        return min(self.covered) <= max(o.covered) and min(o.covered) <= max(self.covered)

    def alike(self, o):
        for x, y in ((self, o), (o, self)):
            for a, b in x.junctions:
                if any(p in y.covered for p in range(a, b)):
                    return False
                if (a, b) not in y.junctions and any(c < b and a < d for c, d in y.junctions):
                    return False
        return True

    def against(self, o):
        if not self.meets(o) or not self.alike(o):
            return None
        both = [k for k in self.calls if k in o.calls]
        same = sum(self.calls[k] == o.calls[k] for k in both)
        if len(both) - same > 0.2 * len(both):
            return None
        if not self.calls and not self.junctions:
            return (0, 0)
        if self.calls and o.calls and not both:
            return None
        support = same + len(self.junctions & o.junctions)
        return (support - (len(both) - same), same) if support >= 1 else None

    def add(self, k, p, n):
        for s, a in p.calls.items():
            self.votes[s][a] += n
            top = max(self.votes[s].values())
            best = [x for x, v in self.votes[s].items() if v == top]
            self.calls.pop(s, None)
            if len(best) == 1:
                self.calls[s] = best[0]
        self.covered |= p.covered
        self.junctions |= p.junctions
        self.members.append(k)
        self.n += n


def plain_tolerant(fragments, support):
    share = defaultdict(list)
    for _, _, _, al in fragments:
        for s, a in al.items():
            share[s].append(a)
    silent = {s for s, v in share.items() if sum(v) / len(v) > 0.9}
    pats = {}
    for i, blocks, js, al in sorted(fragments):
        pats.setdefault((frozenset(js), frozenset(al.items())), []).append((i, blocks))
    items = []
    for (js, al), rows in pats.items():
        cov = {p for _, bs in rows for a, b in bs for p in range(a, b)}
        full = dict(al)
        items.append((Plain(cov, js, {s: a for s, a in full.items() if s not in silent}), [i for i, _ in rows], len(js) + len(full)))
    items.sort(key=lambda t: (-t[2], -len(t[1]), t[1][0]))
    order = sorted(range(len(items)), key=lambda k: (min(items[k][0].covered), -items[k][2], -len(items[k][1]), items[k][1][0]))

    def found(p, pool):
        c = [(*a, k) for k in sorted(pool) if (a := p.against(pool[k])) is not None]
        if any(x[1] for x in c):
            c = [x for x in c if x[1]]
        return sorted(c, key=lambda x: -x[0])

    sure = lambda c: len(c) == 1 or (len(c) > 1 and c[0][0] - c[1][0] >= 2)
    groups = {}
    for k in order:
        p, ids, _ = items[k]
        c = found(p, groups)
        if sure(c):
            groups[c[0][2]].add(k, p, len(ids))
        elif not c and (p.calls or p.junctions):
            g = groups[len(groups)] = Plain(set(p.covered), (), {})
            g.add(k, p, len(ids))
    bridge = defaultdict(int)
    for p, ids, _ in items:
        if p.calls:
            on = [k for _, s, k in found(p, groups) if s]
            for x in on:
                for y in on:
                    if x != y:
                        bridge[x, y] += len(ids)
    queue, apart = list(groups), set()
    while queue:
        x = queue.pop(0)
        if x not in groups:
            continue
        ok = []
        for y in sorted(groups):
            if y != x and (a := groups[x].against(groups[y])) is not None:
                if a[1] >= 2 or bridge[x, y] >= 2 or (not groups[x].calls and not groups[y].calls and a[0] >= 2):
                    ok.append((-a[0], y))
        ok.sort()

        def odds(a, b):
            return a.meets(b) and (not a.alike(b) or any(s in b.calls and b.calls[s] != v for s, v in a.calls.items()))

        ys = [groups[y] for _, y in ok]
        if any(odds(a, b) for i, a in enumerate(ys) for b in ys[i + 1 :]):
            apart.add(x)
            continue
        if not ok:
            continue
        y = ok[0][1]
        keep, gone = (x, y) if groups[x].n >= groups[y].n else (y, x)
        for k in groups[gone].members:
            groups[keep].add(k, items[k][0], len(items[k][1]))
        del groups[gone]
        apart.discard(gone)
        for (a, b), n in list(bridge.items()):
            if a == gone:
                del bridge[a, b]
                if b != keep:
                    bridge[keep, b] += n
            elif b == gone:
                del bridge[a, b]
                if a != keep:
                    bridge[a, keep] += n
        again = sorted({keep} | {z for z in apart if groups[z].meets(groups[keep])})
        apart -= set(again)
        queue += [z for z in again if z not in queue]
    left = {k: g for k, g in groups.items() if g.n >= support}
    while True:
        hits, kept = [], defaultdict(int)
        for p, ids, _ in items:
            c = found(p, left)
            hits.append([c[0][2]] if sure(c) else [x[2] for x in c])
            if len(hits[-1]) == 1:
                kept[hits[-1][0]] += len(ids)
        weak = [k for k in left if kept[k] < support]
        if not weak:
            break
        for k in weak:
            del left[k]
    anchor = {}
    for (_, ids, _), h in zip(items, hits):
        if len(h) == 1:
            anchor[h[0]] = min(anchor.get(h[0], ids[0]), ids[0])
    return {i: ("minor" if not h else "member" if len(h) == 1 else "ambiguous", anchor[h[0]] if len(h) == 1 else None) for (_, ids, _), h in zip(items, hits) for i in ids}


FRAGMENTS = "window string, id long, blocks array<struct<s:int,e:int>>, junctions array<struct<s:int,e:int>>, alleles map<int,boolean>"


def random_fragments(rng, n, sites, errors, spliced):
    rows = []
    truth = [{s: rng.random() < 0.5 for s in sites} for _ in range(2)]
    for s in sites:
        truth[1][s] = not truth[0][s]
    for i in range(n):
        h = rng.randrange(2)
        a = rng.randrange(0, 260)
        b = a + rng.randint(10, 120)
        js = [(100, 130)] if spliced and h == 0 and a < 95 and b > 135 else [(100, 140)] if spliced and a < 95 and b > 145 else []
        blocks = [(a, js[0][0]), (js[0][1], b)] if js else [(a, b)]
        al = {s: truth[h][s] ^ (rng.random() < errors) for s in sites if any(x <= s < y for x, y in blocks) and rng.random() < 0.9}
        rows.append((i, blocks, js, al))
    return rows


@pytest.mark.parametrize("seed,errors,spliced", [(1, 0.02, False), (2, 0.15, True), (3, 0.35, False), (4, 0.05, True)])
def test_tolerant_groups(spark, seed, errors, spliced):
    rng = random.Random(seed)
    windows = {}
    for w in "ab":
        sites = sorted(rng.sample(range(0, 380), rng.choice([5, 25])))
        windows[w] = random_fragments(rng, 70, sites, errors, spliced)
        # far away: another stretch that nothing joins to the first
        windows[w] += [(1000 + i, [(a + 5000, b + 5000) for a, b in bl], [(a + 5000, b + 5000) for a, b in js], {s + 5000: v for s, v in al.items()}) for i, bl, js, al in random_fragments(rng, 25, sites, errors, spliced)]
    rows = [(w, i, bl, js, al) for w, fs in windows.items() for i, bl, js, al in fs] + [("a", 9999, [], [], {})]
    got = {(r["window"], r["id"]): (r["status"], r["anchor"]) for r in tolerant.tolerant_groups(spark.createDataFrame(rows, FRAGMENTS), "window").collect()}
    want = {("a", 9999): ("minor", None)}
    for w, fs in windows.items():
        for part in ([f for f in fs if f[0] < 1000], [f for f in fs if f[0] >= 1000]):
            want |= {(w, i): v for i, v in plain_tolerant(part, 3).items()}
    assert got == want
    assert {v[0] for v in want.values()} >= {"member", "minor"}


@pytest.mark.parametrize("seed,batch,spliced", [(11, 1, True), (12, 7, False), (13, 16, True), (14, 64, False)])
def test_tolerant_hits_over_batches(monkeypatch, seed, batch, spliced):
    """A cluster that grows within a batch is met as it is by the patterns behind, and so over batches."""
    monkeypatch.setattr(tolerant, "BATCH", batch)
    rng = random.Random(seed)
    sites = sorted(rng.sample(range(0, 380), 25))
    rows = random_fragments(rng, 120, sites, 0.1, spliced)
    pair = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
    ends = lambda x: [{"s": a, "e": b} for a, b in x]
    t = pa.table({"id": [r[0] for r in rows], "blocks": pa.array([ends(r[1]) for r in rows], pair), "junctions": pa.array([ends(r[2]) for r in rows], pair), "alleles": pa.array([rng.sample(list(r[3].items()), len(r[3])) for r in rows], pa.map_(pa.int32(), pa.bool_()))})
    patterns, numbered = tolerant.alike(t)
    share = {s: [r[3][s] for r in rows if s in r[3]] for s in sites}
    hits = tolerant.tolerant_hits(patterns, numbered, [s for s, v in share.items() if v and sum(v) / len(v) > 0.9], 3)
    first = {}
    for p, h in zip(patterns, hits):
        if len(h) == 1:
            first[h[0]] = min(first.get(h[0], p.rows[0]), p.rows[0])
    got = {i: ("minor" if not h else "member" if len(h) == 1 else "ambiguous", first[h[0]] if len(h) == 1 else None) for p, h in zip(patterns, hits) for i in p.rows}
    assert got == plain_tolerant(rows, 3)


def test_tolerant_hits_where_few_patterns_agree(monkeypatch):
    """Fragments that hardly agree are clustered like others, however many they are, and by boards of any size (F12)."""
    rng = random.Random(9)
    rows = random_fragments(rng, 420, list(range(0, 380, 2)), 0.5, False)
    pair = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
    ends = lambda x: [{"s": a, "e": b} for a, b in x]
    t = pa.table({"id": [r[0] for r in rows], "blocks": pa.array([ends(r[1]) for r in rows], pair), "junctions": pa.array([ends(r[2]) for r in rows], pair), "alleles": pa.array([list(r[3].items()) for r in rows], pa.map_(pa.int32(), pa.bool_()))})
    patterns, numbered = tolerant.alike(t)
    share = {s: [r[3][s] for r in rows if s in r[3]] for s in range(0, 380, 2)}
    silent, want = [s for s, v in share.items() if v and sum(v) / len(v) > 0.9], plain_tolerant(rows, 2)
    for cells, counts, linked in ((tolerant.CELLS, tolerant.COUNTS, tolerant.LINKED), (500, 2000, 7)):
        for name, v in (("CELLS", cells), ("COUNTS", counts), ("LINKED", linked)):
            monkeypatch.setattr(tolerant, name, v)
        hits = tolerant.tolerant_hits(patterns, numbered, silent, 2)
        first = {}
        for p, h in zip(patterns, hits):
            if len(h) == 1:
                first[h[0]] = min(first.get(h[0], p.rows[0]), p.rows[0])
        got = {i: ("minor" if not h else "member" if len(h) == 1 else "ambiguous", first[h[0]] if len(h) == 1 else None) for p, h in zip(patterns, hits) for i in p.rows}
        assert got == want


def test_tolerant_groups_of_many_sites(spark):
    """Thousands of sites, two haplotypes: two groups hold nearly all, though no two fragments are equal."""
    rng = random.Random(7)
    sites = list(range(0, 30_000, 10))
    truth = {s: rng.random() < 0.5 for s in sites}
    rows = []
    for i in range(120):
        a = rng.randrange(0, 25_000)
        b = a + 5000
        al = {s: (truth[s] ^ (i % 2 == 1)) ^ (rng.random() < 0.05) for s in sites if a <= s < b}
        rows.append(("w", i, [(a, b)], [], al))
    got = tolerant.tolerant_groups(spark.createDataFrame(rows, FRAGMENTS), "window").collect()
    own = defaultdict(set)
    for r in got:
        if r["status"] == "member":
            own[r["anchor"]].add(r["id"] % 2)
    assert sum(r["status"] == "member" for r in got) >= 115 and all(len(v) == 1 for v in own.values()) and len(own) <= 4


# ---- rescue, placed clips, insertions ----------------------------------------------------------------------------------


def test_clip_ends_and_rescue(spark):
    rng = random.Random(21)
    refs = {"1": dna(rng, 900), "2": dna(rng, 700)}
    bps = [("1", "split", 200, 500), ("1", "deletion", 201, 620), ("1", "duplication", 300, 660), ("1", "inversion", 350, 800), ("2", "split", 100, 400), ("2", "inversion", 100, 300), ("2", "duplication", 402, 600)]

    def target(kind, at_start, side, d, s, e, n, ref):
        lo, hi = s + d, e + d
        cut = lambda a: ref[a : a + n] if 0 <= a and a + n <= len(ref) else None
        back = lambda a: turn(cut(a)) if cut(a) else None
        table = {
            ("deletion", True, "right"): lambda: cut(hi), ("deletion", False, "left"): lambda: cut(lo - n),
            ("duplication", False, "right"): lambda: cut(lo), ("duplication", True, "left"): lambda: cut(hi - n),
            ("inversion", True, "right"): lambda: back(hi - n), ("inversion", False, "right"): lambda: back(lo - n),
            ("inversion", False, "left"): lambda: back(lo), ("inversion", True, "left"): lambda: back(hi),
        }
        f = table.get(("deletion" if kind == "split" else kind, at_start, side))
        return f() if f else None

    reads, want_ends = [], {}
    for i in range(260):
        c = rng.choice("12")
        _, kind, s, e = rng.choice([b for b in bps if b[0] == c])
        at_start, side, d, n = rng.random() < 0.5, rng.choice(["left", "right"]), rng.choice([-3, -2, -1, 0, 0, 1, 2]), rng.choice([5, 8, 10, 12, 25, 45])
        pos = (s if at_start else e) + d
        clip = target(kind, at_start, side, d, s, e, n, refs[c]) or dna(rng, n)
        clip = "".join("ACGT"["ACGT".index(x) ^ 1] if rng.random() < rng.choice([0, 0, 0.03]) else x for x in clip)
        hard = rng.random() < 0.15
        body = dna(rng, 30)
        sa = "2,5,+,30M;" if rng.random() < 0.05 else rng.choice([None, ""])
        op = f"{n}{'H' if hard else 'S'}"
        cigar, start = (f"{op}30M", pos) if side == "left" else (f"10M2D20M{op}", pos - 32)
        seq = None if rng.random() < 0.05 else body if hard else clip + body if side == "left" else body + clip
        reads.append((c, i, start, cigar, seq, sa))
        if not sa and ((hard and n >= 20) or (not hard and n >= 8 and seq)):
            want_ends[i] = (c, pos, side, "" if hard else clip, hard, n)
    df = spark.createDataFrame(reads, "contig string, id long, start int, cigar string, seq string, sa string").withColumn("ops", cigar_ops(F.col("cigar")))
    ends = rescue.clip_ends(df, ["contig"])
    assert {r["id"]: (r["contig"], r["pos"], r["side"], r["seq"], r["hard"], r["n"]) for r in ends.collect()} == want_ends
    want = {}
    for i, (c, pos, side, clip, hard, n) in want_ends.items():
        near = [(k, s, e, at, pos - (s if at else e)) for cc, k, s, e in bps if cc == c for at in (True, False) if abs(pos - (s if at else e)) <= (0 if k == "deletion" else 2)]
        if hard:
            hits = [x for x in near if x[0] == "inversion" or (x[3] == (side == "right")) == (x[0] != "duplication")]
        elif n < (12 if len(near) > 1 else 8):
            hits = []
        else:
            hits = []
            for x in near:
                t = target(x[0], x[3], side, x[4], x[1], x[2], n, refs[c])
                if t and sum(a != b for a, b in zip(clip, t)) <= n // 20:
                    hits.append(x)
        if len(hits) == 1:
            want[i] = (c, *hits[0][:3])
    b = spark.createDataFrame(bps, "contig string, kind string, s int, e int")
    got = rescue.rescued(ends, b, tiles_of(spark, refs, 64), "contig", 64)
    assert {r["id"]: (r["contig"], r["kind"], r["s"], r["e"]) for r in got.collect()} == want and len(want) > 50
    counts = {(r["kind"], r["s"]): (r["count"], r["hard"], r["long"]) for r in rescue.rescued_counts(got, ["contig"]).collect()}
    assert sum(v[0] for v in counts.values()) == len(want) and sum(v[1] for v in counts.values()) == sum(want_ends[i][4] for i in want)


def test_placed_clusters_make_arcs(spark):
    rng = random.Random(22)
    ref = dna(rng, 3000)
    cases = {  # clip at, side, what it reads: an arc (kind, s, e)
        "a": (500, "right", ref[1200:1240], ("split", 500, 1200)), "b": (1200, "left", ref[460:500], ("split", 500, 1200)),
        "c": (1500, "right", ref[700:740], ("duplication", 700, 1500)), "d": (700, "left", ref[1460:1500], ("duplication", 700, 1500)),
        "e": (600, "right", turn(ref[1960:2000]), ("inversion", 600, 2000)), "f": (2000, "left", turn(ref[600:640]), ("inversion", 600, 2000)),
    }
    rows, want = [], {}
    for k, (on, (pos, side, clip, arc)) in enumerate(cases.items()):
        for i in range(rng.choice([3, 5])):
            n = rng.choice([30, 38, 40])
            rows.append((on, k * 10 + i, pos, side, clip[:n] if side == "right" else clip[-n:], False, n))
        rows.append((on, k * 10 + 9, pos, side, "", True, 33))
        rows.append((on, k * 10 + 8, pos + 7, side, clip, False, 40))
        want[on] = (pos, side, *arc)
    ends = spark.createDataFrame(rows, "contig string, id long, pos int, side string, seq string, hard boolean, n int")
    windows = spark.createDataFrame([(on, 0, ref) for on in cases], "contig string, start int, seq string")
    got = rescue.realigned(ends, windows, "contig").collect()
    assert {r["contig"]: (r["pos"], r["side"], r["kind"], r["s"], r["e"]) for r in got} == want
    assert all(r["hard"] == 1 and r["count"] in (4, 6) for r in got)
    arcs = spark.createDataFrame([("a", "split", 500, 1200, 2)], "contig string, kind string, s int, e int, n int")
    tiles = tiles_of(spark, {on: ref for on in cases}, 128)
    moved = {(r["contig"], r["kind"]): (r["n"], r["by_clip"], r["by_rescue"]) for r in rescue.own_evidence(arcs, ends, windows, tiles, "contig", 128).collect()}
    own = {r["contig"]: r["count"] for r in got}
    assert moved["a", "split"] == (2 + own["a"], own["a"], 0) and moved["e", "inversion"] == (own["e"], own["e"], 0)
    left = rescue.clusters_left(ends, spark.createDataFrame([("a", "right", 500)], "contig string, side string, pos int"), ends.limit(0), "contig").collect()
    assert {r["contig"] for r in left} == set("bcdef")


def test_insertions_and_tandem_copies(spark):
    rng = random.Random(23)
    refs = {"1": dna(rng, 1500)}
    ref, rows = refs["1"], []
    for i in range(300):
        p = rng.choice([300, 303, 306, 312, 700, 1100, 1104])
        n = rng.choice([60, 63, 66, 120])
        rows.append(("1", p, n, rng.choice([None, "", ref[p - n : p]]), i))
    groups = []
    for _, p, n, s, _ in rows:
        g = next((g for g in groups if abs(g[0] - p) <= 5 and abs(g[1] - n) <= 0.1 * g[1]), None)
        if g is None:
            groups.append([p, n, s, 1])
        else:
            g[3] += 1
            g[2] = g[2] or s
    got = rescue.insertion_groups(spark.createDataFrame(rows, "contig string, pos int, len int, seq string, ord int"), "contig")
    assert sorted((r["pos"], r["len"], r["reads"], r["seq"] or "") for r in got.collect()) == sorted((p, n, k, s or "") for p, n, s, k in groups)
    cases = [(400, ref[300:400]), (400, ref[400:520]), (405, ref[300:400]), (800, dna(rng, 90)), (900, ref[850:890]), (30, ref[:30] + dna(rng, 40) + ref[6:30]), (1460, ref[1460:1500] + dna(rng, 40)), (600, ref[500:540] + dna(rng, 60))]
    g = spark.createDataFrame([("1", p, len(s), s.lower() if k == 0 else s, 4) for k, (p, s) in enumerate(cases)], "contig string, pos int, len int, seq string, reads long")

    def plain(p, s):
        n = len(s)
        if n < 48:
            return None

        def near(probe, at):
            k = ref.find(probe, max(0, at - 60))
            return k if k >= 0 and abs(k - at) <= 60 else None

        for before in (True, False):
            inner = near(s[-24:], p - 24) if before else near(s[:24], p)
            if inner is None:
                continue
            want = p - n if before else p + n - 24
            ok = want - 60 >= 0 and want + 24 + 60 <= len(ref)
            far = near(s[:24] if before else s[-24:], want) if ok else None
            if ok and far is None:
                continue
            return ((far if far is not None else inner + 24 - n), inner + 24) if before else (inner, far + 24 if far is not None else inner + n)
        return None

    got = {(r["pos"], r["len"]): (r["s"], r["e"]) if r["s"] is not None else None for r in rescue.tandem_copies(g, tiles_of(spark, refs, 100), "contig", 100).collect()}
    assert got == {(p, len(s)): plain(p, s) for p, s in cases} and sum(v is not None for v in got.values()) >= 3


# ---- shares of events, variants, streams -------------------------------------------------------------------------------


def plain_shares(js, ex, span):
    ex = sorted(ex)
    out, pools = {}, {}
    skip = {}
    for s, e in js:
        li = [k for k, x in enumerate(ex) if x[1] == s]
        ri = [k for k, x in enumerate(ex) if x[0] == e]
        if li and ri and ri[-1] > li[-1] + 1:
            skip[s, e] = (li[-1], ri[-1] - 1)
    for k in range(len(ex) - 1):
        a, b = ex[k][1], ex[k + 1][0]
        if b <= a:
            continue
        r = (span[a, "s"] + span[b, "e"]) if (a, "s") in span and (b, "e") in span else None
        lefts = sorted(((s, e) for s, e in js if s == a and e < b), key=lambda x: (-js[x], x))
        rights = {(s, e) for s, e in js if e == b and s > a}
        pairs = []
        for x in lefts:
            fit = sorted((-js[y], y[0] - x[1], y) for y in rights if 0 < y[0] - x[1] <= 500)
            if fit:
                pairs.append((x, fit[0][2], (js[x] + js[fit[0][2]]) / 2))
                rights.discard(fit[0][2])
        used = {x for p in pairs for x in p[:2]}
        alts = [x for x in js if (x[0] == a or x[1] == b) and x != (a, b) and x not in used and x not in skip]
        sk = [x for x, (p, q) in skip.items() if k in (p, q)]
        c = js.get((a, b), 0)
        total = c + sum(js[x] for x in alts) + sum(p[2] for p in pairs) + sum(js[x] for x in sk) + (r or 0) / 2
        pools[k] = (a, b, r, pairs, alts, sk, c, total)
    for k, (a, b, r, pairs, alts, sk, c, total) in pools.items():
        if r is not None:
            out[k, a, b, "retention"] = r / 2 / total if total else 0.0
        if not total:
            continue
        for x, y, n in pairs:
            out[k, *x, "cryptic_exon"] = out[k, *y, "cryptic_exon"] = n / total
        for x in alts:
            out[k, *x, "alternative"] = js[x] / total
        if (a, b) in js:
            value = c / total
            if len(sk) == 1:
                o = [q for q in skip[sk[0]] if q != k]
                other = pools.get(o[0]) if o else None
                pure = lambda p: p and p[5] == sk and not p[3] and not p[4] and not p[2]
                if pure(pools[k]) and pure(other):
                    value = (c + other[6]) / (c + other[6] + 2 * js[sk[0]])
            out[k, a, b, "canonical"] = value
    for x, (p, q) in skip.items():
        if p in pools and q in pools and pools[p][7] + pools[q][7] > 0:
            out[p, *x, "skip"] = 2 * js[x] / (pools[p][7] + pools[q][7])
    return out


@pytest.mark.parametrize("seed", [31, 32, 33])
def test_event_shares(spark, seed):
    rng = random.Random(seed)
    ex = [("c", a, a + rng.choice([60, 100, 200])) for a in range(0, 3000, 300)] + [("c", 3300, 3400), ("c", 3400, 3500)]
    want, rows, spans = {}, [], []
    for sample in "xyz":
        js = {}
        ends, starts = [e for _, _, e in ex], [s for _, s, _ in ex]
        for _ in range(rng.choice([6, 60])):
            s = rng.choice(ends) if rng.random() < 0.7 else rng.randrange(3000)
            e = rng.choice([x for x in starts if x > s] or [s + 10]) if rng.random() < 0.6 else s + rng.randint(5, 400)
            js[s, e] = rng.randint(1, 9)
        span = {}
        for s, e in zip(ends, starts[1:]):
            if rng.random() < 0.5:
                span[s, "s"] = rng.choice([0, 4])
            if rng.random() < 0.6:
                span[e, "e"] = rng.choice([0, 3])
        rows += [("c", sample, s, e, n) for (s, e), n in js.items()]
        spans += [("c", sample, "intronStart" if w == "s" else "intronEnd", p, n) for (p, w), n in span.items()]
        want |= {(sample, *k): round(v, 9) for k, v in plain_shares(js, [x[1:] for x in ex], span).items()}
    got = events.event_shares(
        spark.createDataFrame(rows, "contig string, sample string, s int, e int, n int"), spark.createDataFrame(ex, "contig string, xs int, xe int"), "contig", ["contig", "sample"],
        spark.createDataFrame(spans, "contig string, sample string, side string, pos int, n int"),
    ).collect()
    assert {(r["sample"], r["k"] - 1, r["s"], r["e"], r["event"]): round(r["share"], 9) for r in got} == want
    assert {k[-1] for k in want} == {"retention", "cryptic_exon", "alternative", "canonical", "skip"}


def test_called_variants(spark):
    rng = random.Random(34)
    rows, depth, over, counts = [], Counter(), Counter(), Counter()
    for i in range(400):
        start, parts = rng.randrange(60), []
        at, q, seq = start, 0, ""
        for _ in range(rng.randint(1, 4)):
            n = rng.randint(3, 9)
            parts.append(f"{n}M")
            for p in range(at, at + n):
                depth["c", p] += 1
            at, seq = at + n, seq + "A" * n
            kind, n = rng.choice("IDXN"), rng.randint(1, 3)
            parts.append(f"{n}{kind}")
            if kind == "I":
                counts["c", at, "ins", f"+{n}"] += 1
                seq += "C" * n
            elif kind == "D":
                counts["c", at, "del", f"-{n}"] += 1
                for p in range(at, at + n):
                    over["c", p] += 1
                at += n
            elif kind == "X":
                for p in range(at, at + n):
                    b = rng.choice("GT")
                    seq += b
                    counts["c", p, "snv", b] += 1
                    depth["c", p] += 1
                at += n
            else:
                at += n
        parts.append("2M")
        for p in (at, at + 1):
            depth["c", p] += 1
        rows.append(("c", start, "".join(parts), seq + "AA"))
    want = {}
    for (c, p, kind, alt), n in counts.items():
        d = depth[c, p] if kind == "snv" else max(n, depth[c, p] + over[c, p])
        if n >= 3 and n / d >= 0.04:
            want[p, kind, alt] = (n, d)
    df = spark.createDataFrame(rows, "contig string, start int, cigar string, seq string").withColumn("ops", cigar_ops(F.col("cigar")))
    got = {(r["pos"], r["kind"], r["alt"]): (r["alt_count"], r["depth"]) for r in variants.called_variants(df, ["contig"], 0.04).collect()}
    assert got == want and {k[1] for k in want} == {"snv", "ins", "del"}


def test_growing_stretches(spark, tmp_path):
    """However the input is cut into batches and restarts, the runs are those of all intervals at once; a batch that runs again changes nothing."""
    from tidespan.operators.intervals import depth_runs
    from tidespan.streaming import stretches

    rng = random.Random(35)
    rows = [(rng.choice("ab"), s, s + rng.choice([0, 5, 90, 400])) for s in rng.choices(range(1000), k=300)]
    schema = "contig string, s long, e long"
    want = {tuple(r) for r in depth_runs(spark.createDataFrame(rows, schema), ["contig"]).collect()}
    for cuts in ([300], [100, 200, 300], [1, 299, 300]):
        d = tmp_path / f"run{len(cuts)}{cuts[0]}"
        stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in")  # noqa: B023, E731
        at = 0
        for k, to in enumerate(cuts):
            spark.createDataFrame(rows[at:to], schema).coalesce(1).write.mode("append").parquet(f"{d}/in")
            at = to
            stretches.start(stream(), f"{d}/out", f"{d}/check", tile=64).awaitTermination()
        assert {tuple(r) for r in stretches.stretch_runs(spark, f"{d}/out").collect()} == want
        t = stretches.tiles(spark, f"{d}/out").collect()
        assert sum(r["intervals"] for r in t) == sum(s < e for _, s, e in rows)
        assert all(p < (r["tile"] + 1) * 64 for r in t for p in r["owned_pos"]) and all(p >= (r["tile"] + 1) * 64 for r in t for p in r["spilled_pos"])


# ---- joints and chains -------------------------------------------------------------------------------------------------


def test_joints(spark):
    rng = random.Random(41)
    ref = dna(rng, 6000)
    shared = ref[:1000] + ref[3000:3007] + ref[1007:3000] + ref[3000:]  # seven bases alike at 1000 and 3000
    refs = {"1": shared}
    tiles = tiles_of(spark, refs, 256)
    js = [(1, "1", 1000, "tail", "1", 3000, "head"), (2, "1", 2000, "tail", "1", 4000, "tail"), (3, "1", 500, "head", "1", 1500, "head"), (4, "1", 1200, "tail", "1", 5000, "head"), (5, "1", 5500, "tail", "1", 5900, "head")]
    parts = []

    def read(name, seq, segments):
        for k, (s, e, rev, qs, qe) in enumerate(segments):
            parts.append((name, f"{name}r", k, "1", s, e, rev, qs, qe, seq))

    for i in range(5):  # a deletion with shared bases: the read could go either way
        seq = shared[900:1000] + shared[3000:3100]
        read(f"a{i}", seq, [(900, 1007, False, 0, 107), (3000, 3100, False, 100, 200)])
    read("a9", "A" * 200, [(900, 1000, False, 0, 100), (3003, 3100, False, 103, 200)])
    for i in range(3):  # tails joined: the second part is reversed; and read from the other end
        seq = shared[1900:2000] + turn(shared[3900:4000])
        read(f"b{i}", seq, [(1900, 2000, False, 0, 100), (3900, 4000, True, 100, 200)])
        read(f"c{i}", turn(seq), [(3900, 4000, False, 0, 100), (1900, 2000, True, 100, 200)])
    ins = turn(shared[5300:5330])
    for i in range(4):  # inserted bases that are a copy from the other strand near by
        seq = shared[1100:1200] + ins + shared[5000:5100]
        read(f"d{i}", seq, [(1100, 1200, False, 0, 100), (5000, 5100, False, 130, 230)])
    seq = shared[5400:5500] + "ACGT" + shared[5900:5990]
    read("e", seq, [(5400, 5500, False, 0, 100), (5900, 5990, False, 104, 194)])
    read("far", seq, [(5400, 5479, False, 0, 100), (5900, 5990, False, 104, 194)])
    df = spark.createDataFrame(parts, "name string, read string, ord int, contig string, s int, e int, rev boolean, qs int, qe int, seq string")
    jdf = spark.createDataFrame(js, "junction int, a_contig string, a_pos int, a_side string, b_contig string, b_pos int, b_side string")
    got = {r["junction"]: r for r in joints.joints(df, jdf, tiles, 256).collect()}
    assert set(got) == {1, 2, 4, 5}
    assert (got[1]["reads"], got[1]["agree"], got[1]["ins"], got[1]["pos_a"], got[1]["pos_b"]) == (6, 5, "", 1007, 3000)
    # slid both ways from where the reads put it: the shared bases and what happens to agree beside them
    left = next(k for k in range(300) if shared[999 - k] != shared[2999 - k])
    right = next(k for k in range(300) if shared[1000 + k] != shared[3000 + k])
    assert (got[1]["slide_left"], got[1]["slide_right"]) == (left, right) and right >= 7 and got[1]["homology"] == shared[1000 - left : 1000 + right] and got[1]["hint"] == "microhomology"
    assert (got[2]["reads"], got[2]["agree"]) == (6, 6) and (got[2]["pos_a"], got[2]["pos_b"]) == (2000, 4000)
    assert (got[4]["ins"], got[4]["t_pos"], got[4]["t_strand"], got[4]["mismatches"], got[4]["hint"]) == (ins, 5300, "-", 0, "templated")
    assert (got[5]["reads"], got[5]["ins"], got[5]["hint"]) == (1, "ACGT", "few_inserted")


def plain_chains(frags):
    """Fragments (der, idx, tx, gene, way, left_cut, right_cut) to links, greedily by rank and order."""
    out = set()
    for d, k in {(f[0], f[1]) for f in frags}:
        left = sorted((f for f in frags if f[:2] == (d, k) and f[6]), key=lambda f: f[2])
        right = sorted((f for f in frags if f[:2] == (d, k + 1) and f[5]), key=lambda f: f[2])
        pairs = [(0 if a[2] == b[2] else 1 if a[3] == b[3] else 2, a, b) for a in left for b in right if a[4] == b[4]]
        used_a, used_b = set(), set()
        for _, a, b in sorted(pairs, key=lambda p: p[0]):
            if a[2] not in used_a and b[2] not in used_b:
                used_a.add(a[2])
                used_b.add(b[2])
                out.add((d, k, a[2], b[2]))
    return out


def test_links_of_fragments(spark):
    rng = random.Random(42)
    frags = []
    for d in range(3):
        for k in range(5):
            for t in rng.sample(range(8), 5):
                frags.append((d, k, t, f"g{t % 3}", rng.choice([1, -1]), rng.random() < 0.7, rng.random() < 0.7))
    df = spark.createDataFrame([("e", *f) for f in frags], "event string, der int, idx int, tx int, gene string, way int, left_cut boolean, right_cut boolean")
    got = {(r["der"], r["idx"], r["tx"], r["to_tx"]) for r in derivatives.links(df).collect()}
    assert got == plain_chains(frags) and len(got) > 10


def test_fates_of_transcripts(spark):
    """Events on one chromosome of 10,000 bases: each kind of impact, and fusions by their phase."""
    tx = [("t1", "A", "1", 1, 1000, 2000), ("t2", "B", "1", 1, 4000, 5000), ("t3", "C", "1", -1, 7000, 8000), ("t4", "D", "1", 1, 9000, 9300)]
    ex = [("t1", k + 1, 1000 + k * 200, 1100 + k * 200) for k in range(5)] + [("t2", k + 1, 4000 + k * 200, 4100 + k * 200) for k in range(5)] + [("t3", 5 - k, 7000 + k * 200, 7100 + k * 200) for k in range(5)] + [("t4", 1, 9000, 9300)]
    cds = [("t1", 1050, 1850), ("t2", 4050, 4850), ("t3", 7050, 7850)]

    def event(name, cuts, order):
        bounds = [0, *cuts, 10_000]
        seg = [(bounds[k], bounds[k + 1], k == 0, k == len(bounds) - 2) for k in range(len(bounds) - 1)]
        return [(name, 0, i, "1", *seg[abs(k) - 1][:2], k < 0, *seg[abs(k) - 1][2:]) for i, k in enumerate(order)]

    pieces = (
        event("del_exons", [1150, 1550], [1, 3])  # t1 loses exons 2 and 3 of 100 coding bases each
        + event("dup_exon", [1150, 1350], [1, 2, 2, 3])
        + event("fusion", [1750, 4350], [1, 3])  # t1 exons 1-4 onto t2 exons 3-5
        + event("lost", [3500, 5500], [1, 3])
        + event("twice", [3500, 5500], [1, 2, 2, 3])
        + event("turned", [3500, 5500], [1, -2, 3])
        + event("inside", [1150, 1950], [1, -2, 3])  # an inversion that cuts t1 twice
        + event("copy", [4450, 8500], [1, 2, 2, 3])
    )
    ev = [(n, "1", 0, 10_000) for n in dict.fromkeys(p[0] for p in pieces)]
    fused, fate = derivatives.transcript_fates(
        spark.createDataFrame(tx, "tx string, gene string, contig string, strand int, ts int, te int"), spark.createDataFrame(ex, "tx string, rank int, xs int, xe int"), spark.createDataFrame(cds, "tx string, cs int, ce int"),
        spark.createDataFrame(pieces, "event string, der int, idx int, contig string, ps int, pe int, reversed boolean, first boolean, last boolean"), spark.createDataFrame(ev, "event string, contig string, ws int, we int"),
    )
    got = {(r["event"], r["tx"]): r for r in fate.collect()}
    kind = lambda e, t: got[e, t]["kind"]
    assert kind("del_exons", "t1") == "intragenic_del" and got["del_exons", "t1"]["lost"] == "2,3" and got["del_exons", "t1"]["frame"] == "shifted"
    assert kind("dup_exon", "t1") == "intragenic_dup" and got["dup_exon", "t1"]["repeated"] == "2"
    assert kind("fusion", "t1") == kind("fusion", "t2") == "fusion" and kind("fusion", "t3") == "unaffected"
    assert kind("lost", "t2") == "deleted" and kind("twice", "t2") == "duplicated" and kind("turned", "t2") == "moved" and kind("lost", "t4") == "unaffected"
    assert kind("inside", "t1") == "disrupted" and got["inside", "t1"]["intact"] == 0
    assert kind("copy", "t3") == "duplicated" and kind("copy", "t2") == "partial_copy" or kind("copy", "t2") in ("partial_copy", "intragenic_dup", "disrupted")
    f = {(r["event"], r["five"], r["three"]): r for r in fused.collect()}
    r = f["fusion", "t1", "t2"]
    # 350 coding bases before it, 150 before exon 3 of the other: 350 % 3 = 2, 150 % 3 = 0
    assert (r["five_last"], r["three_first"], r["kind"], r["frame"]) == (4, 3, "out_of_frame", "shifted")


# ---- repeats -----------------------------------------------------------------------------------------------------------


def plain_fit(pat, text):
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(pat, 1):
        cur = [i]
        for j, d in enumerate(text, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != d)))
        prev = cur
    best = min(prev)
    return best, prev.index(best)


def noisy(rng, s, rate):
    out = ""
    for c in s:
        r = rng.random()
        out += "" if r < rate / 3 else c + rng.choice("ACGT") if r < 2 * rate / 3 else rng.choice("ACGT") if r < rate else c
    return out


def test_anchors(spark):
    import numpy as np

    rng = random.Random(51)
    for _ in range(60):
        pat, text = dna(rng, rng.randint(1, 20)), dna(rng, rng.randint(0, 40))
        ed, end = repeats.fits(repeats.coded(pat)[None, :], repeats.coded(text)[None, :], np.array([len(text)]))
        assert (int(ed[0]), int(end[0])) == plain_fit(pat, text)
    anchor = dna(rng, 40)
    texts = [dna(rng, 80) + noisy(rng, anchor, r) + dna(rng, 90) for r in (0, 0, 0.04, 0.08, 0.3)] + [dna(rng, 30) + anchor + dna(rng, 50) + anchor, "ACG", dna(rng, 200), anchor[:39]]
    for before in (True, False):
        got = repeats.anchor_places([repeats.coded(t) for t in texts], anchor, before)
        for t, places in zip(texts, got):
            # every place is one where the whole anchor fits, and exact copies are found
            for pos, ed in places:
                part = t[max(0, pos - 56) : pos] if before else t[pos : pos + 56][::-1]
                assert ed <= 6 and plain_fit(anchor if before else anchor[::-1], part)[0] <= ed
            exact = [i for i in range(len(t)) if t[i : i + 40] == anchor]
            assert all(any(p == (i + 40 if before else i) and e == 0 for p, e in places) for i in exact)
    reps = ["CGG", "AGG"]
    near = "CGGCGGCAGCGGCGGTGGCGGCGGCGGAGGCGGCGGCGGCGG" + dna(random.Random(3), 150)
    for before in (True, False):
        stretch = near[::-1] if before else near
        a = repeats.chosen_anchor(stretch, reps, before)
        far = lambda w: min(plain_fit(w, m * 40)[0] for m in reps) / 40
        windows = [stretch[len(stretch) - g - 40 : len(stretch) - g] if before else stretch[g : g + 40] for g in range(len(stretch) - 39)]
        want = next(g for g, w in enumerate(windows) if far(w) >= 0.35)
        assert (a.gap, a.seq) == (want, windows[want]) and want > 0
    assert repeats.chosen_anchor("ACGT", reps, True) is None


def test_measured_reads(spark):
    rng = random.Random(52)
    left, right = dna(rng, 200), dna(rng, 200)
    ref = left + "CGG" * 10 + "AGG" + "CGG" * 9 + right
    locus = repeats.locus_of(ref, 200, 260, ["CGG"], [], ["AGG"])
    assert locus.left.seq in left and locus.right.seq in right
    made = {
        "same": (ref, ("spanning", 20)), "long": (left + "CGG" * 55 + right, ("spanning", 55)), "turned": (turn(left + "CGG" * 31 + right), ("spanning", 31)),
        "impure": (left + dna(rng, 90) + right, ("impure", 30)), "left": (left + "CGG" * 40, ("truncated", 40)), "right": ("CGG" * 25 + right, ("truncated", 25)),
        "inside": ("CGG" * 60, ("truncated", 60)), "none": (dna(rng, 300), ("skipped", 0)), "twice": (left + "CGG" * 4 + left, ("chimeric", 0)), "order": (right + "CGG" * 4 + left, ("chimeric", 0)),
        "few": (left + "CGGCGG", ("skipped", 0)), "empty": (None, ("skipped", 0)),
    }
    rows = [(k, "x", s) for k, (s, _) in made.items()] + [("other", "y", ref)]
    got = {r["id"]: r for r in repeats.measure_reads(spark.createDataFrame(rows, "id string, locus string, seq string"), {"x": locus}).collect()}
    assert {k: (r["class"], r["units"]) for k, r in got.items()} == {k: w for k, (_, w) in made.items()}
    assert got["same"]["tokens"] == "P" * 10 + "I" + "P" * 9 and got["turned"]["turned"] and got["right"]["anchored"] == "right" and got["inside"]["anchored"] == "none"
    for n in (20, 60):  # under errors most reads still span, within a few units
        sizes = [repeats.measured([noisy(rng, left + "CGG" * n + right, 0.04)], locus)[0] for _ in range(20)]
        good = [m for m in sizes if m[0] == "spanning"]
        assert len(good) >= 15 and all(abs(m[1] - n) <= 4 for m in good)


def plain_table(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            d[i][j] = i + j if not i or not j else min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return d


def test_alignment_of_units():
    import numpy as np

    rng = random.Random(53)
    for _ in range(200):
        a, b = ([rng.choice(["CGG", "AGG", "CAG"]) for _ in range(rng.randint(0, 9))] for _ in range(2))
        table = alignment.edit_table(np.array(a, object), np.array(b, object))
        want = plain_table(a, b)
        assert table.tolist() == want
        for open_end in (False, True):
            cols, ins = repeats.aligned_units(a, b, open_end)
            end = min(range(len(a) + 1), key=lambda i: want[i][len(b)]) if open_end else len(a)
            assert all(c is None for c in cols[end:]) and all(c is not None for c in cols[:end])
            cost = sum(c != u for c, u in zip(cols[:end], a)) + sum(map(len, ins))
            assert cost == want[end][len(b)]
            back = [u for k in range(len(a) + 1) for u in [*ins[k], *([cols[k]] if k < end and cols[k] != "-" else [])]]
            assert back == b


def test_repeat_consensus(spark):
    rng = random.Random(54)
    truth = ["CGG"] * 12 + ["AGG"] + ["CGG"] * 9
    rows = []
    for i in range(60):
        u = list(truth)
        if rng.random() < 0.3:
            u[rng.randrange(len(u))] = "CAG"
        if rng.random() < 0.2:
            u.insert(rng.randrange(len(u)), "CGG")
        rows.append(("a", i, u, "spanning", "both"))
    rows += [("a", 100 + i, ["CAG"] * 5, "truncated", "left") for i in range(3)]
    rows += [("b", i, truth[: rng.randint(14, 22)], "truncated", "left") for i in range(20)] + [("b", 50 + i, truth[-rng.randint(14, 22) :], "truncated", "right") for i in range(20)]
    rows += [("c", 1, [], "spanning", "both"), ("c", 2, ["CGG"], "chimeric", None), ("d", 1, ["CGG", "AGG"], "spanning", "both")]
    df = spark.createDataFrame(rows, "locus string, id long, units array<string>, class string, anchored string")
    got = {r["locus"]: r for r in repeats.repeat_consensus(df, ["locus"], ["AGG"]).collect()}
    assert set(got) == {"a", "b", "d"}
    assert (got["a"]["used"], got["a"]["structure"], got["a"]["interruptions"], got["a"]["lower_bound"]) == (60, "(CGG)12 AGG (CGG)9", "13", False)
    assert got["b"]["lower_bound"] and got["b"]["used"] == 40 and "AGG" in got["b"]["structure"]
    assert (got["d"]["structure"], got["d"]["size"], got["d"]["mean_support"]) == ("CGG AGG", 2, 1.0)
    thin = repeats.repeat_consensus(df.where("locus = 'a' and class = 'spanning'"), ["locus"], ["AGG"], most=7).first()
    assert thin["used"] == 7 and thin["listed"] == 60


# ---- notation ----------------------------------------------------------------------------------------------------------

LENGTHS = {"chr1": 100_000, "chr2": 80_000, "chrX": 50_000}


def test_notation_round_trip(spark):
    rng = random.Random(61)
    rows, want = [], {}
    for i in range(120):
        c = rng.choice(list(LENGTHS))
        spots = sorted(rng.sample(range(1, LENGTHS[c], 7), 2 * rng.randint(1, 4)))
        ops, pieces, cur = [], [], 0
        keep = lambda a, b: pieces.append((c, a, b, False)) if b > a else None  # noqa: B023, E731
        for a, b in zip(spots[::2], spots[1::2]):
            kind = rng.choice(["del", "dup", "inv", "ins", "delins"])
            oc = rng.choice(list(LENGTHS))
            x = rng.randrange(1, LENGTHS[oc] - 50)
            item, piece = f"{'' if oc == c else oc + ':g.'}{x}_{x + 20}{'inv' if x % 2 else ''}", (oc, x - 1, x + 20, x % 2 == 1)
            more = rng.random() < 0.3
            what = f"[{item};ACGT;{item}]" if more else item
            got = [piece] * (2 if more else 1)
            if kind == "ins":
                ops.append(f"{a}_{a + 1}ins{what}")
                keep(cur, a)
                pieces += got
                cur = a
                continue
            ops.append(f"({a - 1}_{a + 1})_{b}{kind}" if rng.random() < 0.2 and kind != "delins" else f"{a}_{b}{kind}{what if kind == 'delins' else ''}")
            keep(cur, a - 1)
            if kind == "inv":
                pieces.append((c, a - 1, b, True))
            elif kind == "dup":
                pieces += [(c, a - 1, b, False)] * 2
            elif kind == "delins":
                pieces += got
            cur = b
        keep(cur, LENGTHS[c])
        rng.shuffle(ops)
        name = {"chr1": "NC_000001.11", "chr2": "chr2", "chrX": "NC_000023.11"}[c]
        rows.append((i, f" {name}:g.{'[' + ' ;'.join(ops) + ']' if len(ops) > 1 or rng.random() < 0.3 else ops[0]}"))
        want[i] = pieces
    df = notation.parsed(spark.createDataFrame(rows, "id int, text string"), LENGTHS)
    got = {r["id"]: (r["error"], [tuple(p) for p in r["pieces"] or []]) for r in df.collect()}
    assert got == {i: (None, p) for i, p in want.items()}
    # written as a sequence of pieces and read again, they are the same
    again = notation.parsed(df.select("id", notation.sequence_form(F.col("pieces")).alias("text")), LENGTHS)
    assert {r["id"]: [tuple(p) for p in r["pieces"] or []] for r in again.collect() if len(want[r["id"]]) > 1} == {i: p for i, p in want.items() if len(p) > 1}
    js = defaultdict(list)
    for r in notation.typed_junctions(df).collect():
        js[r["id"]].append((r["junction"], r["kind"], r["a_chrom"], r["a_pos"], r["a_side"], r["b_chrom"], r["b_pos"], r["b_side"]))
    for i, ps in want.items():
        own = []
        for p, q in zip(ps, ps[1:]):
            if p[0] == q[0] and p[3] == q[3] and (q[2] == p[1] if p[3] else p[2] == q[1]):
                continue
            a, b = (p[1], "head") if p[3] else (p[2], "tail"), (q[2], "tail") if q[3] else (q[1], "head")
            kind = "translocation" if p[0] != q[0] else "inversion" if a[1] == b[1] else "deletion" if (b[0] > a[0]) == (a[1] == "tail") and b[0] != a[0] else "duplication"
            own.append((len(own) + 1, kind, p[0], *a, q[0], *b))
        assert sorted(js[i]) == own


def test_notation_forms_and_errors(spark):
    texts = {
        "chr1:g.101_200del": (None, "chr1:g.1_100::chr1:g.201_100000"),
        "del(1)(p36.33p36.32) NC_000001.11:g.101_200del": (None, "chr1:g.1_100::chr1:g.201_100000"),
        "1p36.33(101_200)x1": (None, "chr1:g.1_100::chr1:g.201_100000"),
        "1p36.33p36.32(1,001_2,000)×3": (None, "chr1:g.1_1000::chr1:g.1001_2000::chr1:g.1001_2000::chr1:g.2001_100000"),
        "1p36.33(101_200)x2": ("unreadable", None),
        "seq[GRCh38] chr1:g.pter_100::chr1:g.201_300inv::chr1:g.301_qter": (None, "chr1:g.1_100::chr1:g.201_300inv::chr1:g.301_100000"),
        "chr1:g.50001_qterdel": (None, "chr1:g.1_50000"),
        "chr1:g.(100_?)_200del": (None, "chr1:g.1_99::chr1:g.201_100000"),
        "chr1:g.(?_?)_200del": ("unknown_position", None),
        "chr1:g.[1_10del;5_20dup]": ("overlap", None),
        "chr1:g.100_101ins": ("missing_insertion", None),
        "chr1:g.100_101ins[ACGT;N[12]]": (None, "chr1:g.1_100::chr1:g.101_100000"),
        "chr9:g.1_5del": ("unknown_chromosome", None),
        "chr1:g.100A>T": ("unreadable", None),
        "hello": ("unreadable", None),
        "": ("unreadable", None),
        None: ("unreadable", None),
    }
    df = notation.parsed(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), LENGTHS)
    got = {r["text"]: (r["error"], r["form"]) for r in df.select("text", "error", notation.sequence_form(F.col("pieces")).alias("form")).collect()}
    assert got == texts


def plain_junction(s, e, plus, ex, cs, ce):
    """In positions of the genome, strand by strand."""
    order = sorted(ex) if plus else sorted(ex, reverse=True)
    bases = [p for a, b in order for p in (range(a, b) if plus else range(b - 1, a - 1, -1))]
    place = {p: k for k, p in enumerate(bases)}
    z0, z1 = (place[cs], place[ce - 1]) if plus else (place[ce - 1], place[cs])

    def c(p):
        t = place[p]
        return f"-{z0 - t}" if t < z0 else f"*{t - z1}" if t > z1 else str(t - z0 + 1)

    head = lambda x: x[0] if plus else x[1] - 1
    tail = lambda x: x[1] - 1 if plus else x[0]
    donor, acceptor, step = (s - 1, e, 1) if plus else (e, s - 1, -1)
    di = [k for k, x in enumerate(order) if tail(x) == donor]
    ai = [k for k, x in enumerate(order) if head(x) == acceptor]
    if di and ai:
        i, k = di[0], ai[0]
        return "r.(=)" if k == i + 1 else f"r.{c(head(order[i + 1]))}_{c(tail(order[k - 1]))}del" if k > i + 1 else None
    if ai and ai[0] > 0:
        up, here = order[ai[0] - 1], order[ai[0]]
        if up[0] <= donor < up[1] and donor != tail(up):
            return f"r.{c(donor + step)}_{c(tail(up))}del"
        if (donor - tail(up)) * step > 0 and (acceptor - donor) * step > 0:
            return f"r.{c(tail(up))}_{c(head(here))}ins{c(tail(up))}+1_{c(tail(up))}+{abs(donor - tail(up))}"
    if di and di[0] + 1 < len(order):
        here, down = order[di[0]], order[di[0] + 1]
        if down[0] <= acceptor < down[1] and acceptor != head(down):
            return f"r.{c(head(down))}_{c(acceptor - step)}del"
        if (head(down) - acceptor) * step > 0 and (acceptor - donor) * step > 0:
            return f"r.{c(tail(here))}_{c(head(down))}ins{c(head(down))}-{abs(head(down) - acceptor)}_{c(head(down))}-1"
    return None


def test_junction_notation(spark):
    rng = random.Random(62)
    exons, cds, js, want = [], [], [], {}
    for tx in range(4):
        plus, ex, at = tx % 2 == 0, [], 100
        for _ in range(6):
            n = rng.randint(20, 60)
            ex.append((at, at + n))
            at += n + rng.randint(50, 90)
        cs, ce = ex[0][0] + 7, ex[5][0] + 9
        exons += [(tx, plus, a, b) for a, b in ex]
        cds.append((tx, cs, ce))
        for _ in range(150):
            s = rng.choice([rng.choice(ex)[1], rng.choice(ex)[1], rng.randint(100, at)])
            e = rng.choice([x for x in [rng.choice(ex)[0], rng.choice(ex)[0], s + rng.randint(20, 200)] if x > s] or [s + 30])
            js.append((len(js), tx, s, e))
            want[len(js) - 1] = plain_junction(s, e, plus, ex, cs, ce)
    got = notation.junction_notation(spark.createDataFrame(js, "id int, tx int, s int, e int"), spark.createDataFrame(exons, "tx int, plus boolean, xs int, xe int"), spark.createDataFrame(cds, "tx int, cs int, ce int")).collect()
    assert {r["id"]: r["effect"] for r in got} == want
    kinds = Counter("null" if v is None else "eq" if "=" in v else "del" if v.endswith("del") else "ins" for v in want.values())
    assert min(kinds[k] for k in ("null", "eq", "del", "ins")) > 10
