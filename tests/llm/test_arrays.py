"""Whitening, fingerprints and sessions against plain loops, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest

from tidespan.llm import fingerprints, sessions, whitening

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
ZERO = datetime(1970, 1, 1)


def micros(t):
    return (t - ZERO) // timedelta(microseconds=1)


def plain_sessions(rows, gap=1800, length=7200, late=3600):
    first = {}
    for r in rows:
        if None not in (r[0], r[1], r[3]):
            final = r[4] == "purchase" and r[5] is not None and r[5] >= 60
            cents = int(np.floor(100 * r[5] + 0.5)) if r[5] is not None else 0
            x = (micros(r[2] or r[1]), micros(r[1]), r[3], final, cents)
            first[r[0]] = min(first.get(r[0], x), x)
    timely, lates = defaultdict(list), defaultdict(list)
    for cid, (arrived, t, client, final, cents) in first.items():
        (lates if arrived - t > late * 10**6 else timely)[client].append((t, cid, final, cents))
    out = set()
    for client, cs in timely.items():
        cs.sort()
        groups, why = [], []
        for c in cs:
            p = groups[-1][-1] if groups else None
            reason = None if p is None else "end" if p[2] else "gap" if c[0] - p[0] >= gap * 10**6 else "length" if c[0] - groups[-1][0][0] > length * 10**6 else ""
            if reason == "":
                groups[-1].append(c)
            else:
                groups.append([c])
                why.append(reason)
        why = [*why[1:], "end" if groups[-1][-1][2] else "none"]
        for k, g in enumerate(groups):
            until = groups[k + 1][0][0] if k + 1 < len(groups) else None
            n_late = sum(g[0][0] <= x[0] and (until is None or x[0] < until) for x in lates[client])
            path = hashlib.sha256(",".join(str(c[1]) for c in g).encode()).hexdigest()
            out.add((client, g[0][1], g[0][0], g[-1][0], len(g), n_late, sum(c[3] for c in g), why[k], path))
    return out


def random_clicks(rng, n, step, finals=0.03):
    rows, at = [], {c: datetime(2024, 1, 31, 20) for c in (1, 2, 3, None)}
    for i in range(n):
        c = rng.choices([1, 2, 3, None], [60, 25, 10, 1])[0]
        at[c] += timedelta(seconds=rng.choice([0, 1, step, step, 2 * step, 1799, 1800]) if rng.random() < 0.9 else rng.randint(0, 3 * step), microseconds=rng.choice([0, 0, 999_999]))
        ts = at[c] if rng.random() < 0.99 else None
        arrived = None if rng.random() < 0.02 else (ts or at[c]) + timedelta(seconds=rng.choice([0, 5, 3600, 3601, 9000] if rng.random() < 0.2 else [1]))
        kind = rng.choice(["purchase", "view", None])
        value = rng.choice([None, 59.99, 60.0, -1.005, 12.345]) if rng.random() > finals or kind != "purchase" else 60.0
        value = 1.0 if value == 60.0 and rng.random() > finals else value
        rows.append((rng.randrange(1000) * 1000 + i, ts, arrived, c, kind, value, "{}"))
    rows += rng.sample(rows, n // 20)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("step,block", [(40, 8), (200, 5), (600, 64), (3, 7), (900, None)])
def test_sessions_over_blocks(spark, step, block):
    """Blocks so small that chains go over many of them, with and without forced breaks."""
    rng = random.Random(step)
    rows = random_clicks(rng, 700, step, 0.0 if step in (40, 3) else 0.05)
    got = [tuple(r) for r in sessions.sessions(spark.createDataFrame(rows, CLICKS), block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_sessions(rows)


def test_sessions_of_length_alone(spark):
    """One client without any forced break: only the chain of lengths splits it, over dozens of blocks."""
    rng = random.Random(9)
    t, rows = datetime(2024, 2, 1), []
    for i in range(900):
        t += timedelta(seconds=rng.randint(0, 400))
        rows.append((i, t, t, 5, "view", 1.0, None))
    for block in (3, 16, 50, 4096):
        got = {tuple(r) for r in sessions.sessions(spark.createDataFrame(rows, CLICKS), block=block).collect()}
        assert got == plain_sessions(rows) and {g[7] for g in got} == {"length", "none"}


def test_sessions_odd_rows(spark):
    t = datetime(2024, 3, 1)
    empty = spark.createDataFrame([], CLICKS)
    assert sessions.sessions(empty).collect() == []
    rows = [(1, t, t + timedelta(hours=2), 1, "view", 5.0, None), (2, t, t, 1, "purchase", float("nan"), None), (3, t, t, 1, "purchase", float("inf"), None), (4, t, t, 1, "view", 1.0, None), (None, t, t, 1, "view", 1.0, None)]
    got = sorted(tuple(r)[:8] for r in sessions.sessions(spark.createDataFrame(rows, CLICKS).toDF("click_id", "ts", "arrived_at", "client_id", "kind", "value", "closed_by")).collect())
    at = micros(t)
    # the late click comes after all timely ones of its time
    assert got == [(1, 2, at, at, 2, 0, 0, "end"), (1, 4, at, at, 1, 1, 100, "none")]
    only_late = spark.createDataFrame([(1, t, t + timedelta(hours=2), 1, "view", 5.0, None)], CLICKS)
    assert sessions.sessions(only_late).collect() == []


def test_sessions_follow_no_zone(spark):
    rows = random_clicks(random.Random(3), 60, 500)
    df = spark.createDataFrame(rows, CLICKS)
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = {tuple(r) for r in sessions.sessions(df).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == plain_sessions(rows)


def plain_whitening(rows, k=4):
    good = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), dtype=float)
    n, s = len(fit), [sum(int(a) for a in col) for col in fit.T]
    c = fit - np.array(s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1].T
    return good, n, s, e, v


@pytest.mark.parametrize("width,tile,size", [(10, 4, 16), (7, 32, 1024), (3, 1, 5)])
def test_whitening(spark, width, tile, size):
    rng = random.Random(width)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(width)]) for i in range(150)]
    rows += rows[:20] + [(900, None), (901, [None] * width), (902, [float("nan")] * width), (903, [float("inf")] + [0.0] * (width - 1)), (None, rows[3][1]), (904, [0.0] * (width + 1)), (905, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as label", "2 as x", "3 as n")
    got = whitening.whiten(df, size=size, tile=tile).collect()
    good, n, s, e, v = plain_whitening([r for r in rows if r[1] is None or len(r[1]) == width])
    k = min(4, width)
    assert len(got) == k * len(good) and {r["n"] for r in got} == {n}
    want = {i: x for i, x in good}
    signs = defaultdict(set)
    for r in got:
        x = np.array(want[r["vec_id"]])
        j = r["component"] - 1
        assert r["deviation"] == sum((n * int(a) - b) ** 2 for a, b in zip(x, s))
        mine = (x - np.array(s) / n) @ v[j] / np.sqrt(e[j])
        assert abs(abs(mine) - abs(r["whitened"])) < 1e-9
        signs[j] |= {np.sign(mine * r["whitened"])} if abs(mine) > 1e-9 else set()
        assert abs(r["explained"] - e[j] / e.sum()) < 1e-9 and r["identity_error"] < 1e-9
    assert all(len(x) == 1 for x in signs.values())


def test_whitening_without_spread(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whiten(empty).collect() == [] and "identity_error" in whitening.whiten(empty).columns
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert len(same) == 4 and all(r["whitened"] is None and r["deviation"] == 0 and r["n"] == 1 for r in same)
    line = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [3.0, 6.0])], "vec_id long, embedding array<float>")).collect()
    assert {(r["component"], r["whitened"] is None) for r in line} == {(1, False), (2, True)} and line[0]["identity_error"] < 1e-9
    huge = whitening.whiten(spark.createDataFrame([(1, [1e15, 2.0]), (2, [-1e15, 3.0])], "vec_id long, embedding array<double>")).collect()
    assert {r["deviation"] for r in huge} == {None}


def plain_shingles(t):
    import re

    w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in t)) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(a, b):
    a, b = plain_shingles(a), plain_shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = text(600)
    rows = [(i, text(rng.choice([1, 3, 5, 6, 40, 300, 900]))) for i in range(60)]
    rows += [(60, base), (61, base), (62, base.upper()), (63, base[: len(base) // 2] + text(300)), (64, ""), (65, None), (66, "  \n"), (67, "é"), (68, "ab"), (5, rows[5][1]), (None, "null id"), (None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as part", "'x' as kind", "1 as n_chars")
    got = [r.asDict() for r in fingerprints.neighbours(df).collect()]
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    by = defaultdict(list)
    for g in got:
        by[g["doc_id"]].append(g)
    for k, (i, t) in enumerate(order):
        if i is None or i == 5 or order[(k + 1) % len(order)][0] in (None, 5):
            continue
        g, t, nxt = by[i][0], t or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert g["n_chars"] == len(t) and g["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert abs(g["near_edited"] - jaccard(t, e)) < 0.12 and abs(g["near_next"] - jaccard(t, nxt)) < 0.12
    assert by[60][0]["fingerprint"] == by[61][0]["fingerprint"] == by[62][0]["fingerprint"] != by[63][0]["fingerprint"]
    assert len(by[60][0]["fingerprint"]) == 256 and by[64][0]["fingerprint"] == by[65][0]["fingerprint"] == by[66][0]["fingerprint"] == b""
    assert by[60][0]["near_next"] == 1.0 and by[64][0]["near_next"] == 1.0 and by[66][0]["near_next"] == 0.0
    assert {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(df.where("doc_id = 60")).collect()} == {60: by[60][0]["fingerprint"].hex()}
    assert fingerprints.neighbours(df.limit(0)).collect() == []
    (alone,) = fingerprints.neighbours(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).collect()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"a b c a b c").hexdigest()


def test_fingerprints_are_packed_and_fair():
    """Round trip of the bits; the estimate over many pairs has no bias, whatever the size of the sets."""
    rng = np.random.default_rng(1)
    for bits in (1, 2, 4, 8):
        p = fingerprints.Prints(bins=64, bits=bits)
        low = rng.integers(0, 1 << bits, (5, 64)).astype(np.uint8)
        back, some = fingerprints.unpacked_bins(fingerprints.packed(low, np.array([True] * 4 + [False]), bits), p)
        assert (back[:4] == low[:4]).all() and some.tolist() == [True] * 4 + [False]
    import pyarrow as pa

    for words in (12, 60, 700):
        p, errors = fingerprints.Prints(words=1, bins=256, bits=2), []
        for k in range(60):
            shared = [f"s{k}x{i}" for i in range(words // 3)]
            a, b = (shared + [f"{side}{k}x{i}" for i in range(words // 3)] for side in "ab")
            x, some = fingerprints.low_bits(pa.array([" ".join(a), " ".join(b)], pa.large_string()), p)
            errors.append(fingerprints.likeness(x[:1], x[1:], some[:1], some[1:], 2)[0] - 1 / 3)
        assert abs(np.mean(errors)) < 0.04, (words, np.mean(errors))


def test_fingerprints_of_long_texts(spark):
    long = " ".join(f"w{i % 7001}x{i // 7001}" for i in range(200_000))
    rows = [(1, long), (2, long), (3, "y" * 1_000_000), (4, "short")]
    got = {r["doc_id"]: r for r in fingerprints.neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["near_next"] == 1.0 and got[1]["edited_sha256"] == hashlib.sha256((long[: len(long) - len(long) // 2] + long[: len(long) // 2]).encode()).hexdigest()
    assert got[3]["n_chars"] == 1_000_000 and got[2]["near_next"] < 0.05
