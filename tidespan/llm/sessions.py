"""Sessions of clicks by a square-root decomposition of each client's clicks.

A session ends where its last click is final, where a pause follows, or where the next click is too far from its first one.
The first two are seen between neighbours; the third depends on where the session began, so sessions form a chain.

1. clicks, once each, are dealt by range of (client, time), so that a client of a third of all rows lies in many tasks. Each
   task cuts its clicks into blocks of one client each, of about the square root of all rows at most. A reverse sweep over a
   block gives each click, were it a start, its jump (the next start) and its exit start (the last start in the block).
2. a block's summary is tiny: with a forced break inside, every chain leaves it by one exit start. Only a block without a
   break keeps a map from the entering session's start to the exit start, as a step function with one step an exit. Blocks
   of a client are hopped in order, as a fold with a few numbers of state. Clients within one block need no hop.
3. each block then marks its own starts, from the entering session on, and gives whole sessions, and its parts of sessions
   that go over its ends; those parts are put together in order, again as a fold.

Late clicks ride along in the order of time: they start and extend nothing, and count for the session open at their time.

Nulls and odd rows: clicks without click_id, client_id or ts are left out; a null arrived_at is not late; a null or NaN value
is not final and counts 0 cents, as an infinite one does; of rows with one click_id the first to arrive counts (then the least
ts, client_id, final, cents). Ties in ts go by click_id. An empty table gives no sessions; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidespan.session import discard, settings, store

MINUTE = 60_000_000
#: Rows of a block: at least, at most.
LEAST_BLOCK, MOST_BLOCK = 1 << 12, 1 << 20
PART_ROWS = 2_000_000
BATCH_BYTES = 8 << 20
CLICK_BYTES = 26

SUMMARY = "block long, client_id long, alone boolean, clicks long, first_t long, last_t long, last_final boolean, broken boolean, exit_t long, exit_id long, step_t array<long>, step_exit_t array<long>, step_exit_id array<long>"
BLOCKS = f"{SUMMARY}, times binary, ids binary, late binary, final binary, cents binary"
ENTRIES = "block long, entry_t long, entry_id long, prev_t long, prev_final boolean"
PIECES = "client_id long, session_id long, start_us long, block long, end_us long, n_clicks long, n_late long, value_cents long, closed_by string, last_final boolean, path string, path_sha256 string, whole boolean"
SESSIONS = "client_id long, session_id long, start_us long, end_us long, n_clicks long, n_late long, value_cents long, closed_by string, path_sha256 string"


@dataclass(frozen=True)
class Rules:
    """In microseconds: a pause of gap or more ends a session, a click more than length after the first starts another, one that arrives more than late after its time joins none. A click of final_kind with final_value or more is the last of its session."""

    gap: int = 30 * MINUTE
    length: int = 120 * MINUTE
    late: int = 60 * MINUTE
    final_kind: str = "purchase"
    final_value: float = 60.0


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone counts as UTC, whatever the session's zone."""
    at = F.col(name)
    if dict(df.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(at)
    seconds = F.unix_date(at.cast("date")).cast("long") * 86400 + F.hour(at) * 3600 + F.minute(at) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")


def clicks_once(clicks: DataFrame, rules: Rules) -> DataFrame:
    """(click_id, client_id, ts, late, final, cents), a row for each click_id."""
    value = F.when(~F.isnan("value"), F.col("value"))
    cents = F.when(F.abs(value) < float("inf"), F.floor(100 * value + 0.5))
    rows = clicks.select(
        F.col("click_id").cast("long").alias("click_id"),
        F.col("client_id").cast("long").alias("client_id"),
        micros(clicks, "ts").alias("ts"),
        micros(clicks, "arrived_at").alias("arrived"),
        F.coalesce((F.col("kind") == rules.final_kind) & (value >= rules.final_value), F.lit(False)).alias("final"),
        F.coalesce(cents, F.lit(0)).cast("long").alias("cents"),
    ).where("click_id is not null and client_id is not null and ts is not null")
    rows = rows.withColumn("arrived", F.coalesce("arrived", "ts"))
    first = rows.groupBy("click_id").agg(F.min(F.struct("arrived", "ts", "client_id", "final", "cents")).alias("x"))
    return first.select("click_id", "x.client_id", "x.ts", (F.col("x.arrived") - F.col("x.ts") > rules.late).alias("late"), "x.final", "x.cents")


def jumps(t: np.ndarray, final: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """The next start after each click, were it a start (the number of clicks, if there is none here), and the forced breaks."""
    forced = np.flatnonzero(final[:-1] | (t[1:] - t[:-1] >= rules.gap)) + 1
    nearest = np.append(forced, len(t))[np.searchsorted(forced, np.arange(len(t)), side="right")]
    return np.minimum(nearest, np.searchsorted(t, t + rules.length, side="right")), forced


def exits(jump: np.ndarray) -> np.ndarray:
    """The last start of the chain from each click: a sweep from the end."""
    to = jump.tolist()
    n = len(to)
    out = list(range(n))
    for i in range(n - 1, -1, -1):
        if to[i] < n:
            out[i] = out[to[i]]
    return np.array(out, np.int64)


def summary(t: np.ndarray, ids: np.ndarray, final: np.ndarray, rules: Rules) -> tuple:
    """first_t to step_exit_id of a block's timely clicks."""
    if not len(t):
        return None, None, None, False, None, None, [], [], []
    jump, forced = jumps(t, final, rules)
    out = exits(jump)
    steps: tuple[list, list, list] = ([], [], [])
    if not len(forced):
        # an entering session began at t[0] or before: clicks beyond the first that is too late for it are no entries
        reach = out[: np.searchsorted(t, t[0] + rules.length, side="right") + 1]
        last = np.flatnonzero(np.append(reach[1:] != reach[:-1], True))
        steps = t[: len(reach)][last].tolist(), t[reach[last]].tolist(), ids[reach[last]].tolist()
    return int(t[0]), int(t[-1]), bool(final[-1]), bool(len(forced)), int(t[out[0]]), int(ids[out[0]]), *steps


def cut_blocks(clicks: DataFrame, parts: int, block: int, rules: Rules) -> DataFrame:
    """The blocks, in order of their number within a client. alone: the client has no other block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        carry: list[np.ndarray] = []
        split = True  # the carried client may have clicks in the task before, or in blocks already cut
        names = ["client_id", "ts", "click_id", "late", "final", "cents"]

        def add(x: list[np.ndarray], a: int, b: int, alone: bool) -> None:
            nonlocal number
            client, t, ids, late, final, cents = (c[a:b] for c in x)
            timely = ~late
            found = summary(t[timely], ids[timely], final[timely], rules)
            rows.append((number, int(client[0]), alone, int(timely.sum()), *found, *(np.ascontiguousarray(c).tobytes() for c in (t, ids, late, final, cents))))
            number += 1

        def flush() -> pa.RecordBatch:
            types = pa.schema([(n, kinds[k]) for n, k in (f.split(" ") for f in BLOCKS.split(", "))])
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), types, strict=True)], schema=types)
            rows.clear()
            return out

        kinds = {"long": pa.int64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}
        for batch in batches:
            new = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
            x = [np.concatenate(c) for c in zip(carry, new, strict=True)] if carry else new
            edges = [0, *(np.flatnonzero(x[0][1:] != x[0][:-1]) + 1).tolist(), len(x[0])] if len(x[0]) else [0, 0]
            for a, b in zip(edges[:-2], edges[1:-1], strict=True):
                one = not split and b - a <= block
                for k in range(a, b, block):
                    add(x, k, min(k + block, b), one)
                split = False
            a = edges[-2]
            while edges[-1] - a > block:
                add(x, a, a + block, False)
                a, split = a + block, True
            carry = [c[a:] for c in x]
            if sum(r[3] for r in rows) >= 20_000:
                yield flush()
        if carry and len(carry[0]):
            add(carry, 0, len(carry[0]), False)
        if rows:
            yield flush()

    order = ["client_id", "ts", "late", "click_id"]
    dealt = clicks.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return store(dealt.mapInArrow(run, BLOCKS), "session-blocks", records=10_000)


def hop(blocks: DataFrame, rules: Rules) -> DataFrame:
    """(block, entry_t, entry_id, prev_t, prev_final): the session that is open where a block begins, and the click before it; for clients of several blocks. A fold over summaries in order, without their clicks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, entry, prev = None, (None, None), (None, None)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["client_id"] != client:
                    client, entry, prev = r["client_id"], (None, None), (None, None)
                out.append((r["block"], *entry, *prev))
                if not r["clicks"]:
                    continue
                forced = prev[0] is None or prev[1] or r["first_t"] - prev[0] >= rules.gap
                if forced or r["broken"]:
                    entry = r["exit_t"], r["exit_id"]
                else:
                    k = int(np.searchsorted(r["step_t"], entry[0] + rules.length, side="right"))
                    if k < len(r["step_t"]):
                        entry = r["step_exit_t"][k], r["step_exit_id"][k]
                prev = r["last_t"], r["last_final"]
            kinds = [pa.int64()] * 4 + [pa.bool_()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names=[f.split(" ")[0] for f in ENTRIES.split(", ")])

    of_many = blocks.where("not alone").select(*[f.split(" ")[0] for f in SUMMARY.split(", ")])
    return of_many.repartition("client_id").sortWithinPartitions("client_id", "block").mapInArrow(run, ENTRIES)


def marked(r: dict, rules: Rules) -> list[tuple]:
    """The rows of PIECES that a block gives."""
    t, ids, cents = (np.frombuffer(r[c], np.int64) for c in ("times", "ids", "cents"))
    late, final = (np.frombuffer(r[c], bool) for c in ("late", "final"))
    place = np.flatnonzero(~late)
    t, ids, cents, final = t[place], ids[place], cents[place], final[place]
    n, entered = len(t), r["entry_t"] is not None
    starts, why = [], []
    if n:
        jump, forced = jumps(t, final, rules)
        first = 0
        if entered and not r["prev_final"] and t[0] - r["prev_t"] < rules.gap:
            first = min(int(np.searchsorted(t, r["entry_t"] + rules.length, side="right")), int(forced[0]) if len(forced) else n)
        to, broken, i = jump.tolist(), set(forced.tolist()), first
        while i < n:
            starts.append(i)
            if i == 0:
                why.append("end" if r["prev_final"] else "gap" if entered and t[0] - r["prev_t"] >= rules.gap else "length")
            else:
                why.append(("end" if final[i - 1] else "gap") if i in broken else "length")
            i = to[i]
    late_of = np.searchsorted(place[starts] if starts else np.zeros(0, np.int64), np.flatnonzero(late), side="right")
    n_late = np.bincount(late_of, minlength=len(starts) + 1).tolist()
    running = np.concatenate([[0], np.cumsum(cents)])
    texts = list(map(str, ids.tolist()))
    out = []
    edges = [0, *starts, n]
    for k in range(len(starts) + 1):
        a, b = edges[k], edges[k + 1]
        if k == 0 and (not entered or (a == b and not n_late[0] and not starts)):
            continue
        sid, at = (r["entry_id"], r["entry_t"]) if k == 0 else (int(ids[a]), int(t[a]))
        closed = why[k] if k < len(starts) else None
        whole = k > 0 and (closed is not None or r["alone"])
        path = ",".join(texts[a:b])
        if whole and closed is None:
            closed = "end" if final[b - 1] else "none"
        out.append(
            (r["client_id"], sid, at, r["block"], int(t[b - 1]) if b > a else None, b - a, n_late[k], int(running[b] - running[a]), closed, bool(final[b - 1]) if b > a else None)
            + ((None, hashlib.sha256(path.encode()).hexdigest(), True) if whole else (path, None, False))
        )
    return out


def expand(blocks: DataFrame, entries: DataFrame, rules: Rules, batch_rows: int) -> DataFrame:
    """PIECES of all blocks, written."""
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    types = pa.schema([(n, kinds[k]) for n, k in (f.split(" ") for f in PIECES.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for r in batch.to_pylist() for x in marked(r, rules)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), types, strict=True)], schema=types)

    own = ["client_id", "alone", "block", "times", "ids", "late", "final", "cents"]
    none = [F.lit(None).cast(k).alias(n) for n, k in (f.split(" ") for f in ENTRIES.split(", ")[1:])]
    alone = blocks.where("alone").select(*own, *none)
    # merged, so that nothing that grows is broadcast
    others = blocks.where("not alone").select(*own).join(entries.hint("merge"), "block")
    return store(alone.unionByName(others).mapInArrow(run, PIECES), "session-pieces", records=batch_rows)


def joined(pieces: DataFrame, batch_rows: int) -> DataFrame:
    """Sessions that went over the ends of blocks, put together in order: one running hash at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out = None, []

        def done() -> None:
            if key is not None:
                out.append((*key, total["end"], total["n"], total["late"], total["cents"], total["closed"] or ("end" if total["final"] else "none"), total["hash"].hexdigest()))

        def flush() -> pa.RecordBatch:
            kinds = [pa.string() if f.endswith("string") else pa.int64() for f in SESSIONS.split(", ")]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names=[f.split(" ")[0] for f in SESSIONS.split(", ")])
            out.clear()
            return made

        for batch in batches:
            for r in batch.to_pylist():
                if (r["client_id"], r["session_id"], r["start_us"]) != key:
                    done()
                    key = r["client_id"], r["session_id"], r["start_us"]
                    total = {"end": None, "n": 0, "late": 0, "cents": 0, "closed": None, "final": False, "hash": hashlib.sha256()}
                if r["n_clicks"]:
                    total["hash"].update(("," * bool(total["n"]) + r["path"]).encode())
                    total["end"], total["final"] = r["end_us"], r["last_final"]
                total["n"] += r["n_clicks"]
                total["late"] += r["n_late"]
                total["cents"] += r["value_cents"]
                total["closed"] = total["closed"] or r["closed_by"]
            if len(out) >= 1000:
                yield flush()
        done()
        if out:
            yield flush()

    parts = pieces.where("not whole").drop("path_sha256", "whole").repartition("client_id", "session_id").sortWithinPartitions("client_id", "session_id", "block")
    return store(parts.mapInArrow(run, SESSIONS), "sessions-joined", records=batch_rows)


def sessions(clicks: DataFrame, rules: Rules = Rules(), block: int | None = None) -> DataFrame:
    """(client_id, session_id, start_us, end_us, n_clicks, n_late, value_cents, closed_by, path_sha256) of every session. block: rows of a block at most, by default about the square root of the number of clicks."""
    spark = clicks.sparkSession
    once = store(clicks_once(clicks, rules), "session-clicks")
    n = once.count()
    block = block or min(MOST_BLOCK, max(LEAST_BLOCK, 1 << math.ceil(math.log2(max(n, 1)) / 2)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // PART_ROWS)
    batch_rows = max(1, BATCH_BYTES // (CLICK_BYTES * block))
    with settings(spark):
        blocks = cut_blocks(once, parts, block, rules)
    discard(once)
    pieces = expand(blocks, hop(blocks, rules), rules, batch_rows)
    discard(blocks)
    names = [f.split(" ")[0] for f in SESSIONS.split(", ")]
    return pieces.where("whole").select(*names).unionByName(joined(pieces, batch_rows))


def op13_gap_sessions(spark, sf_dir: str) -> DataFrame:
    return sessions(spark.read.parquet(f"{sf_dir}/clicks.parquet"))


#: The chain of starts by recursion: the next start is the first forced break, or the first click too late for the session.
ORACLE_OP13 = """
with recursive once as (
    select distinct on (click_id) click_id, client_id, epoch_us(ts) as t, epoch_us(arrived_at) - epoch_us(ts) > 3600000000 as late,
        coalesce(kind = 'purchase' and value >= 60, false) as final, coalesce(floor(100 * value + 0.5), 0)::bigint as cents
    from clicks where client_id is not null and ts is not null and click_id is not null
    order by click_id, arrived_at, ts, client_id),
timely as (
    select *, row_number() over w as k, lag(final) over w as prev_final, t - lag(t) over w as pause
    from once where not late window w as (partition by client_id order by t, click_id)),
noted as (select *, coalesce(prev_final or pause >= 1800000000, true) as forced from timely),
breaks as (
    select *, min(case when forced then k end) over (partition by client_id order by k rows between 1 following and unbounded following) as next_break,
        count(*) over (partition by client_id order by t range between current row and 7200000000 following) + count(*) over (partition by client_id order by t range between unbounded preceding and current row)
            - count(*) over (partition by client_id, t) as within
    from noted),
jumps as (select client_id, k, least(coalesce(next_break, within + 1), within + 1) as nxt from breaks),
chain as (
    select client_id, 1::bigint as k from jumps where k = 1
    union all
    select j.client_id, j.nxt from chain c join jumps j on j.client_id = c.client_id and j.k = c.k
        where exists (select 1 from timely t where t.client_id = j.client_id and t.k = j.nxt)),
marks as (select n.*, c.k is not null as starts from noted n left join chain c on c.client_id = n.client_id and c.k = n.k),
numbered as (select *, sum(starts::int) over (partition by client_id order by k) as s from marks),
grouped as (
    select client_id, s, min(t) as start_us, max(t) as end_us, count(*) as n_clicks, sum(cents)::bigint as value_cents,
        arg_min(click_id, k) as session_id, arg_max(final, k) as last_final, string_agg(click_id::varchar, ',' order by k) as path,
        bool_or(starts and prev_final) as by_end, bool_or(starts and pause >= 1800000000) as by_gap
    from numbered group by client_id, s),
spans as (
    select *, lead(start_us) over w as next_start, lead(by_end) over w as next_end, lead(by_gap) over w as next_gap
    from grouped window w as (partition by client_id order by s)),
lates as (
    select p.client_id, p.s, count(*) as n_late from spans p join once o on o.client_id = p.client_id and o.late and o.t >= p.start_us
        and (p.next_start is null or o.t < p.next_start) group by p.client_id, p.s)
select p.client_id, session_id, start_us, end_us, n_clicks, coalesce(n_late, 0)::bigint as n_late, value_cents,
    case when next_start is null then case when last_final then 'end' else 'none' end when next_end then 'end' when next_gap then 'gap' else 'length' end as closed_by,
    sha256(path) as path_sha256
from spans p left join lates l on l.client_id = p.client_id and l.s = p.s
"""
