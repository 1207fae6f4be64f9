"""Repeats in reads: anchors beside a tract, reads measured between them, and the consensus of their tracts in units.

Anchors are found approximately: exact 10-mers, every second one of the anchor, propose places, and the whole anchor is
aligned there with free ends. Alignments of a batch of reads are computed together, one row of the table at a time.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidespan.operators.alignment import edit_table, moves, paired
from tidespan.session import dealt, store

#: Bases of an anchor, how far from the tract it may begin, share of its bases by which it differs from the repeat, edits let pass; seed and its step; slack around a proposed place; purity of a tract; units of a lower bound and of a read that is all repeat, and its share; window and share of a run.
ANCHOR, REACH, LEAST_FAR, MOST_EDITS = 40, 150, 0.35, 6
SEED, STEP, SLACK = 10, 2, 8
PURITY, LEAST_UNITS, ALL_REPEAT, ALL_SHARE = 0.8, 3, 10, 0.8
RUN_WINDOW, RUN_SHARE = 10, 0.6

CODES = np.full(256, 4, np.uint8)
CODES[list(b"ACGT")] = range(4)


def coded(text: str) -> np.ndarray:
    return CODES[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]


def turned(text: str) -> str:
    return text[::-1].translate(str.maketrans("ACGT", "TGCA"))


def fits(patterns: np.ndarray, texts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of patterns and of texts (padded; of those lengths): the fewest edits of the whole pattern anywhere in the text, and where the first such place ends."""
    n, width = len(texts), texts.shape[1]
    at = np.arange(width + 1)
    row = np.zeros((n, width + 1), np.int64)
    for k in range(patterns.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = k + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (texts != patterns[:, k : k + 1]), row[:, 1:] + 1)
        # what comes from the left costs one a step: a running minimum along the diagonal
        row = np.minimum.accumulate(new - at, axis=1) + at
    row = np.where(at[None, :] <= lengths[:, None], row, 1 << 20)
    return row.min(axis=1), row.argmin(axis=1)


@dataclass(frozen=True)
class Anchor:
    seq: str
    gap: int


def chosen_anchor(stretch: str, repeats: list[str], before: bool, size: int = ANCHOR) -> Anchor | None:
    """The stretch of 40 bases nearest the tract that differs from the repeats, written out, by 35 % of its bases; without one, the one that differs most (of those within a hundredth, the nearest). before: the stretch ends at the tract."""
    gaps = [g for g in range(len(stretch) - size + 1)]
    windows = [stretch[len(stretch) - g - size : len(stretch) - g] if before else stretch[g : g + size] for g in gaps]
    kept = [(g, w) for g, w in zip(gaps, windows, strict=True) if "N" not in w]
    if not kept:
        return None
    pattern = np.stack([coded(w) for _, w in kept])
    far = np.full(len(kept), size)
    for m in repeats:
        text = coded(m * -(-3 * size // len(m)))
        far = np.minimum(far, fits(pattern, np.broadcast_to(text, (len(kept), len(text))), np.full(len(kept), len(text)))[0])
    good = np.flatnonzero(far / size >= LEAST_FAR)
    best = int(good[0]) if len(good) else 0
    if not len(good):
        for k in range(1, len(far)):
            if far[k] / size > far[best] / size + 0.01:
                best = k
    return Anchor(kept[best][1], kept[best][0])


@dataclass(frozen=True)
class Locus:
    """motifs in the reference's direction: pathogenic, benign, interruptions, all of one length."""

    left: Anchor
    right: Anchor
    pathogenic: tuple[str, ...]
    benign: tuple[str, ...] = ()
    interruptions: tuple[str, ...] = ()

    @property
    def unit(self) -> int:
        return len(self.pathogenic[0])

    def backwards(self) -> Locus:
        flip = lambda ms: tuple(m[::-1] for m in ms)
        return Locus(self.left, self.right, flip(self.pathogenic), flip(self.benign), flip(self.interruptions))


def locus_of(ref: str, start: int, end: int, pathogenic: list[str], benign: list[str] = (), interruptions: list[str] = ()) -> Locus | None:
    """The locus of a tract [start, end) in a reference stretch, with anchors on both sides; None where there is no room for them."""
    if start < ANCHOR + 10 or end + ANCHOR + 10 > len(ref):
        return None
    motifs = list(dict.fromkeys([*pathogenic, *benign]))
    left = chosen_anchor(ref[max(0, start - REACH - ANCHOR) : start], motifs, True)
    right = chosen_anchor(ref[end : end + REACH + ANCHOR], motifs, False)
    return Locus(left, right, tuple(pathogenic), tuple(benign), tuple(interruptions)) if left and right else None


def seed_keys(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For coded texts laid one behind the other, the number of the 10-mer that begins at each base, -1 where it holds an N or leaves its text; and where each text begins."""
    gap = np.full(SEED, 4, np.uint8)
    flat = np.concatenate([x for t in texts for x in (t, gap)]) if texts else gap
    begins = np.cumsum([0, *(len(t) + SEED for t in texts)])
    n = len(flat) - SEED + 1
    key, bad = np.zeros(n, np.int64), np.zeros(n, bool)
    for j in range(SEED):
        part = flat[j : j + n]
        key += part.astype(np.int64) << 2 * j
        bad |= part > 3
    key[bad] = -1
    return key, begins


def anchor_places(texts: list[np.ndarray], anchor: str, before: bool, keys: tuple[np.ndarray, np.ndarray] | None = None) -> list[list[tuple[int, int]]]:
    """(position, edits) of the anchor in each coded text, from left to right: where it ends (before the tract) or begins. Places nearer than half an anchor to one before are the same. keys: seed_keys() of the texts, where they are known."""
    a = coded(anchor)
    size = len(a)
    powers = 4 ** np.arange(SEED, dtype=np.int64)
    seeds: dict[int, list[int]] = {}
    for o in range(0, size - SEED + 1, STEP):
        seeds.setdefault(int((a[o : o + SEED] * powers).sum()), []).append(o)
    key, begins = keys or seed_keys(texts)
    known = np.zeros(4**SEED + 1, bool)  # the last one is that of -1
    known[[k for k in seeds if k < 4**SEED]] = True
    spots = np.flatnonzero(known[key])
    own = np.searchsorted(begins, spots, side="right") - 1
    proposed: dict[int, list[int]] = {}
    for i, s, k in zip(own.tolist(), (spots - begins[own]).tolist(), key[spots].tolist(), strict=True):
        proposed.setdefault(i, []).extend(s - o for o in seeds[k])
    places: list[tuple[int, int]] = []
    for i, starts in proposed.items():
        starts.sort()
        k = 0
        while k < len(starts):
            to = k
            while to + 1 < len(starts) and starts[to + 1] - starts[k] <= SLACK:
                to += 1
            places.append((i, max(0, starts[(k + to) >> 1] - SLACK)))
            k = to + 1
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not places:
        return out
    width = size + 2 * SLACK
    cut = np.full((len(places), width), 5, np.uint8)
    lengths = np.zeros(len(places), np.int64)
    for k, (i, s) in enumerate(places):
        part = texts[i][s : s + width] if before else texts[i][s : s + width][::-1]
        cut[k, : len(part)], lengths[k] = part, len(part)
    pattern = np.broadcast_to(a if before else a[::-1], (len(places), size))
    edits, ends = fits(pattern, cut, lengths)
    for (i, s), ed, end, n in zip(places, edits.tolist(), ends.tolist(), lengths.tolist(), strict=True):
        pos = s + end if before else s + n - end
        if ed <= MOST_EDITS and not any(abs(p - pos) < size / 2 for p, _ in out[i]):
            out[i].append((pos, ed))
    return out


def tokens(tract: str, locus: Locus) -> tuple[str, list[int]]:
    """P, B, I or o for each unit of a tract in the motif's phase, and where it ends; bases before the next pathogenic or benign unit within one unit are passed over."""
    k, kind = locus.unit, {m: c for c, ms in (("I", locus.interruptions), ("B", locus.benign), ("P", locus.pathogenic)) for m in ms}
    out, ends, i = [], [], 0
    while i + k <= len(tract):
        c = kind.get(tract[i : i + k], "")
        ahead = next((j for j in range(1, k) if kind.get(tract[i + j : i + j + k]) in ("P", "B")), 0) if not c else 0
        if ahead:
            i += ahead
            continue
        i += k
        out.append(c or "o")
        ends.append(i)
    return "".join(out), ends


def run(text: str, locus: Locus) -> tuple[int, int]:
    """(units, bases) of the stretch at the start that is rich in the motif: up to its last unit before fewer than 60 % of the last ten are units of it."""
    tok, ends = tokens(text, locus)
    good = np.array([c != "o" for c in tok], bool)
    if not good.any():
        return 0, 0
    total = np.concatenate([[0], np.cumsum(good)])
    at = np.arange(1, len(good) + 1)
    held = total[at] - total[np.maximum(at - RUN_WINDOW, 0)]
    poor = np.flatnonzero((at >= LEAST_UNITS) & (held < RUN_SHARE * np.minimum(at, RUN_WINDOW)))
    kept = np.flatnonzero(good[: poor[0]] if len(poor) else good)
    return (int(kept[-1]) + 1, ends[kept[-1]]) if len(kept) else (0, 0)


def purity(tok: str) -> float:
    return sum(c != "o" for c in tok) / len(tok) if tok else 1.0


MEASURED = "class string, units int, tokens string, purity double, tract_s int, tract_e int, anchored string, turned boolean"


def measured(texts: list[str], locus: Locus) -> list[tuple]:
    """MEASURED of reads: both directions are tried, the read's own first. An anchor found twice, or the right one before the left one, makes it chimeric; both make it spanning, or impure under a purity of 0.8; one gives a lower bound from three units on; none, if nearly all of it is repeat, another. Else it is skipped."""
    both = [[t, turned(t)] for t in texts]
    flat = [coded(t) for pair in both for t in pair]
    keys = seed_keys(flat)
    lefts, rights = anchor_places(flat, locus.left.seq, True, keys), anchor_places(flat, locus.right.seq, False, keys)
    size = lambda bases: int(bases / locus.unit + 0.5)
    skipped = ("skipped", 0, "", 0.0, 0, 0, None, False)

    def one(k: int) -> tuple:
        for way, s in enumerate(both[k]):
            left, right = lefts[2 * k + way], rights[2 * k + way]
            if not left and not right:
                continue
            if len(left) > 1 or len(right) > 1 or (left and right and right[0][0] < left[0][0]):
                return ("chimeric", 0, "", 0.0, 0, 0, None, bool(way))
            a = left[0][0] + locus.left.gap if left else None
            b = right[0][0] - locus.right.gap if right else None
            if left and right:
                b = max(a, b)
                tok = tokens(s[a:b], locus)[0]
                share = purity(tok)
                return ("spanning" if share >= PURITY else "impure", size(len(s[a:b])), tok, share, a, b, "both", bool(way))
            n, bases = run(s[a:], locus) if left else run(s[: max(0, b)][::-1], locus.backwards())
            if n < LEAST_UNITS:
                return skipped
            a, b = (a, a + bases) if left else (b - bases, b)
            tok = tokens(s[a:b], locus)[0]
            return ("truncated", size(bases), tok, purity(tok), a, b, "left" if left else "right", bool(way))
        n, bases = run(both[k][0], locus)
        if n >= ALL_REPEAT and bases >= ALL_SHARE * len(both[k][0]):
            tok = tokens(both[k][0][:bases], locus)[0]
            return ("truncated", size(bases), tok, purity(tok), 0, bases, "none", False)
        return skipped

    return [one(k) for k in range(len(texts))]


def portions(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in portions of some `most` bases, as a portion's 10-mers are held together."""
    part, bases = [], 0
    for t in texts:
        part.append(t)
        bases += len(t)
        if bases >= most:
            yield part
            part, bases = [], 0
    if part:
        yield part


def measure_reads(reads: DataFrame, loci: dict[str, Locus], locus: str = "locus") -> DataFrame:
    """reads (id, locus, seq) with MEASURED of the locus they name; a null sequence counts as empty, reads of other loci are left out. loci is a catalogue: its size is that of the catalogue and not of the reads."""
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    types = [(n, kinds[k]) for n, k in (f.split(" ") for f in MEASURED.split(", "))]
    id_type = dict(reads.dtypes)["id"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column("locus").to_pylist(), [t or "" for t in batch.column("seq").to_pylist()]
            for name in dict.fromkeys(names):
                rows = [i for i, n in enumerate(names) if n == name]
                found = list(zip(*[x for part in portions([texts[i] for i in rows]) for x in measured(part, loci[name])], strict=True))
                own = batch.select(["id", "locus"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, k) for c, (_, k) in zip(found, types, strict=True))], names=["id", "locus", *(n for n, _ in types)])

    known = reads.where(F.col(locus).isin(*loci)).select("id", F.col(locus).alias("locus"), "seq")
    return dealt(known, "id", "seq").mapInArrow(scan, f"id {id_type}, locus string, {MEASURED}")


def aligned_units(centre: list[str], read: list[str], open_end: bool) -> tuple[list, list[list[str]]]:
    """What a read has at each unit of the centre (a unit, "-" for a gap, None where it does not reach) and what it inserts before each and at the end. open_end: it may stop early."""
    a, b = np.array(centre, object), np.array(read, object)
    table = edit_table(a, b)
    end = int(table[:, -1].argmin()) if open_end else len(a)
    columns: list = [None] * len(a)
    inserted: list[list[str]] = [[] for _ in range(len(a) + 1)]
    reached = 0
    for i, j in paired(moves(table, a, b), (end, len(b))):
        if i is None:
            inserted[reached].append(read[j])
        else:
            columns[i], reached = "-" if j is None else read[j], i + 1
    return columns, inserted


def votes_of(centre: list[str], units: list[str], open_end: bool, from_right: bool) -> list[tuple[str, int, int, str]]:
    """(what, slot, place, value) of a read's votes: its unit or "-" in a column ("unit"), how many units it inserts before one ("length"), and which ("inserted", by place)."""
    step = -1 if open_end and from_right else 1
    cols, ins = aligned_units(centre[::step], units[::step], open_end)
    out = [("unit", k, 0, v) for k, v in enumerate(cols[::step]) if v is not None]
    for k, part in enumerate(p[::step] for p in ins[::step]):
        if part:
            out += [("length", k, 0, str(len(part))), *(("inserted", k, i, u) for i, u in enumerate(part))]
    return out


def elected(n: int, votes: Iterable[tuple[str, int, int, str, int, int]]) -> list[tuple[str, float]]:
    """(unit, support) of the consensus over a centre of n units, of votes (what, slot, place, value, reads, the first read's rank): a column counts by the reads that reach it, insertions where more than half carry some, with the length most of them have. Of equal votes the one first met wins."""
    polls: dict = defaultdict(list)
    for what, k, place, value, c, first in votes:
        polls[what, k, place].append((c, -first, value))
    total = lambda x: sum(c for c, *_ in x)
    out = []
    for k in range(n + 1):
        reach = max(1, total(polls.get(("unit", min(k, n - 1), 0), ())))
        lengths = polls.get(("length", k, 0), ())
        if total(lengths) > reach / 2:
            tops = [max(polls["inserted", k, i]) for i in range(int(max(lengths)[2]))]
            out += [(u, c / reach) for c, _, u in tops]
        if polls.get(("unit", k, 0)):
            c, _, u = max(polls["unit", k, 0])
            if u != "-":
                out.append((u, c / total(polls["unit", k, 0])))
    return out


CONSENSUS = "used int, listed int, size int, median int, lower_bound boolean, structure string, interruptions string, mean_support double"


VOTES = "what string, slot int, place int, value string"


def repeat_consensus(reads: DataFrame, keys: list[str], interruptions: list[str] = (), most: int | None = None) -> DataFrame:
    """(keys, CONSENSUS) of reads (keys, id, units, class, anchored): units is the tract in units. Spanning reads make it; where there are none, truncated ones do and it is a lower bound. Reads without units, and of other classes, are not used.

    All of a key's reads vote: each is aligned to the one of the upper median size (the first by id). Reads that are alike are
    aligned once, over all tasks, and votes are added up by column, so that what meets in one task goes with the length of the
    tract and not with the reads. most: a key's reads are thinned to so many before, evenly by size (of equals by id).
    """
    # asked for three times below, and long in the making where reads were measured
    usable = store(reads.where(F.col("class").isin("spanning", "truncated") & (F.size("units") > 0)).select(*keys, "id", "units", "class", "anchored").withColumn("_full", F.col("class") == "spanning"), "usable-reads")
    full = usable.groupBy(*keys).agg(F.max("_full").alias("_any"), F.count(F.lit(1)).alias("listed"))
    pool = usable.join(full, keys).where("_full = _any")
    by_size = pool.groupBy(*keys, F.size("units").alias("_n")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys)
    before = by_size.select(*keys, "_n", (F.sum("_c").over(w.orderBy("_n")) - F.col("_c")).alias("_before"), F.sum("_c").over(w).alias("_all"))
    ranked = pool.withColumn("_n", F.size("units")).join(before, [*keys, "_n"])
    chosen = ranked.withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy(*keys, "_n").orderBy("id")) - 1)
    if most is not None:
        step = (F.col("_all") - 1) / F.lit(float(most - 1))
        slot = F.round(F.col("_rank") / step)
        chosen = chosen.where((F.col("_all") <= most) | (F.floor(slot * step + 0.5) == F.col("_rank")))
    turned_ = ~F.col("_full") & F.coalesce(F.col("anchored") == "right", F.lit(False))
    alike = store(chosen.groupBy(*keys, "units", "_n", turned_.alias("_right"), "_full", "listed").agg(F.count(F.lit(1)).alias("_c"), F.min("_rank").alias("_first")), "alike-tracts")
    sizes = alike.groupBy(*keys, "_n").agg(F.sum("_c").alias("_c")).select(*keys, "_n", F.sum("_c").over(w.orderBy("_n")).alias("_to"), F.sum("_c").over(w).alias("used"))
    median = sizes.where(F.col("_to") > F.floor(F.col("used") / 2)).groupBy(*keys, "used").agg(F.min("_n").alias("_n"))
    centres = median.join(alike, [*keys, "_n"]).groupBy(*keys, "used", F.col("_n").alias("median"), "_full", "listed").agg(F.min_by("units", "_first").alias("_centre"))
    types = dict(reads.dtypes)
    key_ddl = ", ".join(f"{k} {types[k]}" for k in keys)

    def poll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            rows = zip(ids, *(batch.column(c).to_pylist() for c in ("_centre", "units", "_full", "_right", "_c", "_first")), strict=True)
            held: dict = {}
            for key, centre, units, is_full, right, c, first in rows:
                for vote in votes_of(centre, units, not is_full, right):
                    n, least = held.get((*key, *vote), (0, first))
                    held[(*key, *vote)] = (n + c, min(least, first))
            cols = list(zip(*((*k, *v) for k, v in held.items()), strict=True)) or [()] * (len(keys) + 6)
            kinds = [*(batch.schema.field(k).type for k in keys), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[*keys, "what", "slot", "place", "value", "_c", "_first"])

    aligned = dealt(alike.join(centres.select(*keys, "_centre"), keys), *keys, "units").mapInArrow(poll, f"{key_ddl}, {VOTES}, _c long, _first long")
    votes = aligned.groupBy(*keys, "what", "slot", "place", "value").agg(F.sum("_c").alias("_c"), F.min("_first").alias("_first"))
    held = set(interruptions)
    names = [f.split(" ")[0] for f in CONSENSUS.split(", ")]
    kinds = [pa.int32()] * 4 + [pa.bool_(), pa.string(), pa.string(), pa.float64()]

    def vote(t: pa.Table) -> pa.Table:
        cast = zip(*(t.column(c).to_pylist() for c in ("what", "slot", "place", "value", "_c", "_first")), strict=True)
        used, listed, median, n, is_full = (t.column(c)[0].as_py() for c in ("used", "listed", "median", "_width", "_full"))
        units = elected(n, cast)
        runs: list[list] = []
        for u, _ in units:
            if runs and runs[-1][0] == u:
                runs[-1][1] += 1
            else:
                runs.append([u, 1])
        shape = " ".join(f"({u}){n}" if n > 1 else u for u, n in runs)
        breaks = ",".join(str(k) for k, (u, _) in enumerate(units, 1) if u in held)
        values = [used, listed, len(units), median, not is_full, shape, breaks, sum(s for _, s in units) / len(units) if units else 0.0]
        return pa.table({c: t.column(c)[:1] for c in keys} | {c: pa.array([v], k) for c, v, k in zip(names, values, kinds, strict=True)})

    meet = votes.join(centres.select(*keys, "used", "listed", "median", "_full", F.size("_centre").alias("_width")), keys)
    return meet.groupBy(*keys).applyInArrow(vote, f"{key_ddl}, {CONSENSUS}")
