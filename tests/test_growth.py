"""Work that grows no faster than the tables: what is alike is asked for once, and no plan makes rows that the result does not need."""

import random

import pytest
from pyspark.sql import functions as F

from tidespan.functions import genetics
from tidespan.operators import annotation, cgh, consequence, derivatives, evidence, flanks, molecules, notation, placement, repeats, rescue, variants
from tidespan.plans import annotated, basics, effects, genomics, more, phased, rebuilt, rules, views

SF = "/root/testdata"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def plain_places(clips, windows):
    turn = lambda x: x[::-1].translate(str.maketrans("ACGTN", "TGCAN"))
    out = {}
    for win, clip, seq, right in clips:
        start, text = windows[win]
        probe = seq[:60] if right else seq[-60:]
        seed, n, hits = probe[:20] if right else probe[-20:], len(probe), []
        for strand, t in (("+", text), ("-", turn(text))):
            hits += [(strand, t, i) for i in range(len(t) - 19) if t[i : i + 20] == seed]
        if len(hits) == 1:
            strand, t, at = hits[0]
            at -= 0 if right else n - 20
            if at >= 0 and at + n <= len(t) and sum(a != b for a, b in zip(t[at : at + n], probe)) <= n // 20:
                s = start + (at if strand == "+" else len(t) - at - n)
                out[win, clip] = (s, s + n, strand)
    return out


def test_clips_are_looked_for_without_rows_of_the_window(spark):
    rng = random.Random(5)
    dna = lambda n: "".join(rng.choices("ACGT", k=n))
    turn = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    windows, clips = {}, []
    for k in range(6):
        once = dna(300)
        windows[f"w{k}"] = (100 * k, once + once[40:90] + dna(30))
        text = windows[f"w{k}"][1]
        for j in range(40):
            a, n = rng.randrange(len(text) - 20), rng.choice([20, 25, 60, 80])
            seq = list(text[a : a + n])
            for _ in range(rng.choice([0, 0, 1, 4])):
                seq[rng.randrange(len(seq))] = rng.choice("ACGT")
            seq = "".join(seq)
            clips.append((f"w{k}", f"{j}", turn(seq) if j % 2 else seq, j % 3 == 0))
    clips = [c for c in clips if len(c[2]) >= 20]
    w = spark.createDataFrame([(k, *v) for k, v in windows.items()], "win string, start int, seq string")
    got = placement.place_clips(spark.createDataFrame(clips, "win string, clip string, seq string, right boolean"), w, "win")
    assert "Generate" not in plan(got)
    assert {(r["win"], r["clip"]): (r["s"], r["e"], r["strand"]) for r in got.collect()} == plain_places(clips, windows)


def test_ends_are_made_once_for_the_evidence_that_moves(spark):
    assert "l_orderkey" not in plan(rebuilt.e29i(spark, f"{SF}/sf0.001"))


def asked_once(df) -> list[bool]:
    """For each side of a join that is dealt by bins: whether its rows were made distinct, counted or ranked before."""
    lines = [x.lstrip(" :+-") for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    below = lambda i: next(x for x in lines[i + 1 :] if not x.startswith(("Project", "Filter")))
    return [below(i).startswith(("Aggregate", "Window")) for i, x in enumerate(lines) if x.startswith("Generate explode(sequence(")]


ALIKE = {
    "d07_nearest_event": basics, "d09_population_matches": genomics, "d10_dgv_hits": annotated, "d11_recurrent_top4": genomics, "d13_genes_of_calls": phased, "d14_lab_benign": genomics, "e49_priority_score": genomics,
    "f05_population_order": rules,
}


@pytest.mark.parametrize("name", ALIKE)
def test_what_is_alike_is_asked_for_once(spark, name):
    found = asked_once(ALIKE[name].QUERIES[name](spark, f"{SF}/sf0.001"))
    assert found and all(found)


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """sf0.01 with every order a second time under another key, and every part a second time under its own."""
    d = str(tmp_path_factory.mktemp("repeated"))
    o, p = (spark.read.parquet(f"{SF}/sf0.01/{t}.parquet") for t in ("orders", "part"))
    o = o.where("o_orderkey < 3000")
    o.union(o.withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000)).write.parquet(f"{d}/orders.parquet")
    p.union(p).write.parquet(f"{d}/part.parquet")
    return d


@pytest.mark.parametrize("name", ALIKE)
def test_copies_are_answered_alike(spark, repeated, name):
    rows = ALIKE[name].QUERIES[name](spark, repeated).collect()
    call = "id" if "id" in rows[0].asDict() else "call"
    key = lambda r, k: (r[call] - k, *[str(v) for c, v in sorted(r.asDict().items()) if c != call])
    first, second = sorted(key(r, 0) for r in rows if r[call] < 1_000_000), sorted(key(r, 1_000_000) for r in rows if r[call] >= 1_000_000)
    assert first and first == second


@pytest.mark.parametrize("name", ["d05_reads_at_sites", "e45_site_evidence"])
def test_sites_meet_reads_that_were_counted(spark, name):
    df = (annotated if name[0] == "d" else views).QUERIES[name](spark, f"{SF}/sf0.001")
    found = asked_once(df)
    assert found and all(found)


def test_bases_are_written_out_for_reads_that_were_counted(spark):
    q = rules.QUERIES["e22_called_bases"](spark, f"{SF}/sf0.001")
    lines = [x.lstrip(" :+-") for x in q._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    inner = next(i for i, x in enumerate(lines) if x.startswith("Generate inline"))
    assert next(x for x in lines[inner + 1 :] if not x.startswith(("Project", "Filter"))).startswith("Aggregate")


@pytest.mark.parametrize("name", ["f01_systematic_thinning", "f03_even_subset"])
def test_ranks_bring_how_many_there_are(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = basics.QUERIES[name](spark, f"{SF}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the order lines twice (for the counts of stretches, and for the rows), and rows with those counts; none by contig alone
    assert got.count("SortMergeJoin") == 3


def test_mates_are_walked_by_their_places(spark):
    rows = [(f"{i}", 10 * i, 10 * i + 5, b, i) for i in range(60) for b in (64, 128)]
    reads = spark.createDataFrame([("c", n, s if b == 64 else e, e if b == 64 else s, b, e - s if b == 64 else s - e, 2 * i + (b == 128)) for n, s, e, b, i in rows], "contig string, name string, s int, mate_s int, bits int, tlen int, id long")
    got = evidence.mates(reads, "contig")
    assert {(r["id"], r["mate"]) for r in got.collect()} == {(2 * i + k, 2 * i + 1 - k) for i in range(60) for k in (0, 1)}
    # a group of its own for each lower position
    assert "_low" in got._jdf.queryExecution().analyzed().toString()


def test_patterns_meet_seeds_with_their_marks(monkeypatch):
    """A pattern is compared with the seeds that have its rarest junction or allele, not with all (F11)."""
    from tidespan.operators import consensus

    asked, fits = [], consensus.Pattern.fits
    monkeypatch.setattr(consensus.Pattern, "fits", lambda p, seed: asked.append(1) or fits(p, seed))
    patterns = [consensus.Pattern(frozenset(), {5: k}, [10 * k, 10 * k + 1, 10 * k + 2], [(0, 9)]) for k in range(200)]
    assert consensus.placed(patterns, 3) == [[k] for k in range(200)]
    assert len(asked) <= 3 * len(patterns)


def test_spans_of_calls_meet_once(spark, monkeypatch):
    """Calls of one span are one row where spans meet; a call whose id comes twice has each other patient once (F19)."""
    from tidespan.operators import intervals

    held = []
    monkeypatch.setattr(intervals, "store", lambda df, name, f=intervals.store: held.append(f(df, name)) or held[-1])
    calls = [(k, k % 8, "1", "gain", 100, 199) for k in range(40)] + [(3, 3, "1", "gain", 110, 199)]
    got = intervals.recurrence(spark.createDataFrame(calls, "call int, patient int, chrom string, kind string, s int, e int")).collect()
    assert held[0].count() == 2
    assert sorted(map(tuple, got)) == sorted((k, p, 90 if p == 3 and k % 8 == 3 else 100) for k in range(40) for p in range(8) if p != k % 8)


def test_intervals_that_are_alike_are_one_row_where_they_are_merged(spark):
    """(F34)"""
    from tidespan.operators import intervals

    df = spark.createDataFrame([("a", 0, 9)] * 50 + [("a", 4, 12), ("b", 0, 9), (None, 0, 9)], "contig string, s int, e int")
    got = intervals.merged(df, ["contig"])
    logical = got._jdf.queryExecution().optimizedPlan().toString()
    assert any("Aggregate [contig#" in line and ", s#" in line and ", e#" in line.split("], [")[0] for line in logical.splitlines()), logical
    assert sorted(map(tuple, got.select("s", "e", "members").collect())) == [(0, 9, 1), (0, 9, 1), (0, 12, 51)]


def test_reads_that_are_alike_are_walked_as_one_row(spark):
    """(F35)"""
    walk = evidence.RowWalk(4)
    assert list(walk.take(0, 9, 3)) == [(0, 9, 0), (0, 9, 1), (0, 9, 2)]
    assert list(walk.take(5, 9, 2)) == [(5, 9, 3), (5, 9, -1)] and list(walk.take(10, 12, 1)) == [(10, 12, 0)]
    df = spark.createDataFrame([("a", 0, 9)] * 3 + [("a", 4, 12), ("a", 10, 12)], "contig string, s int, e int")
    assert sorted((r["s"], r["row"]) for r in evidence.packed_rows(df, "contig").collect()) == [(0, 0), (0, 1), (0, 2), (4, 3), (10, 0)]


def test_only_starts_that_hold_the_first_reads_are_put_in_order(spark):
    """(F38)"""
    assert "_before#" in plan(basics.c15(spark, f"{SF}/sf0.001")) and "LeftSemi" in plan(basics.c15(spark, f"{SF}/sf0.001"))


def test_calls_and_regions_that_are_alike_meet_once(spark, monkeypatch):
    """Calls with the same genes are one row where they meet regions, and so are regions that ask the same (F12)."""
    from tidespan.operators import readouts

    held = []
    monkeypatch.setattr(readouts, "store", lambda df, name, f=readouts.store: held.append(f(df, name)) or held[-1])
    calls = spark.createDataFrame([(k, "1", "gain", 10, 20) for k in range(30)], "call int, chrom string, kind string, s int, e int")
    genes = spark.createDataFrame([(k, g, k % 2 == 0, True) for k in range(30) for g in ("a", "b")], "call int, symbol string, whole boolean, exons boolean")
    regions = spark.createDataFrame([(k, "gain", "1", None, None, ["overlaps", "contains"][k % 2], True) for k in range(10)], "region int, kind string, chrom string, rs int, re int, match string, typed boolean")
    of = spark.createDataFrame([(k, g) for k in range(10) for g in ("a", "b")], "region int, symbol string")
    got = readouts.region_hits(calls, genes, regions, of).collect()
    assert [x.count() for x in held] == [2, 2]
    assert sorted(map(tuple, got)) == sorted((c, r, "takes" if r % 2 == 0 else "spans") for c in range(30) for r in range(10) if r % 2 == 0 or c % 2 == 0)


def tasks_of(df) -> int:
    """Tasks of the last stage that an action on all of df has."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_translation_is_dealt_over_all_cores(spark):
    df = more.QUERIES["x10_translation"](spark, f"{SF}/sf0.001")
    assert tasks_of(df) >= 4 * spark.sparkContext.defaultParallelism
    assert "REPARTITION_BY_NUM" in plan(df)
    codons = [("".join(c),) for c in ("TTT", "ggg", "AUG", "uag", "TAN", "T T", " TT", "AT", "ACGT", "TGG")]
    got = [r[0] for r in spark.createDataFrame(codons, "c string").coalesce(1).select(genetics.amino_acid(F.col("c"))).collect()]
    assert got == ["F", "G", "M", "*", "X", "X", "X", "X", "X", "W"]


def test_motifs_are_counted_without_rows_of_units(spark):
    df = effects.QUERIES["x24_motifs"](spark, f"{SF}/sf0.001")
    assert "Generate" not in plan(df) and "explode" not in plan(df)
    assert tasks_of(df) >= 4 * spark.sparkContext.defaultParallelism
    rows = [(1, "CAGCAGCAGCAGCA"), (2, None), (3, "AC"), (4, "NNNNNNNNN"), (5, "ACACACACACGTTGCA"), (None, "AAAAAA"), (7, "ACACAC"), (7, "ACACGT")]
    got = {r[0]: (r[1], round(r[2], 6)) for r in consequence.motifs(spark.createDataFrame(rows, "id int, seq string"), "id").collect()}
    # the share of two texts of one stretch is of both, as in the SQL
    assert got == {1: ("AGC", 1.0), 5: ("AC", 0.666667), None: ("A", 1.0), 7: ("AC", 1.6)}, got


def test_flanks_that_are_alike_are_aligned_once_and_over_all_cores(spark):
    rows = [(i, "ACGT" * 5 + "ACG"[: i % 3], "ACGTA" * 4, i % 2 == 0) for i in range(40)] + [(98, None, "ACGT", True), (99, "ACGT", None, None)]
    df = flanks.aligned_flanks(spark.createDataFrame(rows, "id long, read string, flank string, at_end boolean").coalesce(1))
    assert tasks_of(df) >= 4 * spark.sparkContext.defaultParallelism
    want = {i: flanks.aligned(r or "", f or "", bool(e)) for i, r, f, e in rows}
    assert {r[0]: (r[1], r[2]) for r in df.collect()} == want


def test_modified_bases_are_decoded_over_all_cores(spark):
    rows = [(i, "C+m?,0,1;C+h?,0;", [200, 30, 90] if i % 3 else None, "ACCGCTTC"[i % 2 :], i % 4 == 0) for i in range(40)] + [(98, None, [1], "CC", False), (99, "C+m,0;", [7], None, True)]
    df = molecules.decode_modifications(spark.createDataFrame(rows, "id long, mm string, ml array<int>, seq string, reverse boolean").coalesce(1))
    assert tasks_of(df) >= 4 * spark.sparkContext.defaultParallelism
    want = sorted((i, *x) for i, mm, ml, s, r in rows for x in molecules.modified_bases(mm, ml, s or "", r))
    assert want and sorted(tuple(r) for r in df.collect()) == want


def test_descriptions_are_read_over_all_cores(spark):
    texts = spark.createDataFrame([(i, f"chr1:g.{i + 5}_{i + 50}del") for i in range(40)] + [(99, None)], "id long, text string").coalesce(1)
    df = notation.parsed(texts, {"chr1": 1000})
    assert tasks_of(df) >= 4 * spark.sparkContext.defaultParallelism
    got = {r["id"]: (r["error"], r["pieces"] and [(p["s"], p["e"]) for p in r["pieces"]]) for r in df.collect()}
    assert got[3] == (None, [(0, 7), (53, 1000)]) and got[99][1] is None and len(got) == 41


def test_reads_of_a_repeat_are_measured_over_all_cores_and_in_portions(spark, monkeypatch):
    left, right = "ACGTTGCAAGCTTAGCCATGGATCCTAGGCATTCGATCAA", "TTGACCATGCAAGTCCGATTACGGATCTTAGCCTAGGTAC"
    locus = repeats.Locus(repeats.Anchor(left, 0), repeats.Anchor(right, 0), ("CGG",))
    texts = [left + "CGG" * n + right[: 40 - 40 * (n % 4 == 0)] for n in range(3, 30)] + ["", "ACGTN", repeats.turned(left + "CGG" * 9 + right)]
    assert [x for part in repeats.portions(texts, 300) for x in repeats.measured(part, locus)] == repeats.measured(texts, locus)
    df = repeats.measure_reads(spark.createDataFrame([(i, "x", t) for i, t in enumerate(texts)], "id long, locus string, seq string").coalesce(1), {"x": locus})
    assert tasks_of(df) >= 4 * spark.sparkContext.defaultParallelism
    assert [tuple(r[2:]) for r in df.orderBy("id").collect()] == repeats.measured(texts, locus)


def test_consensus_of_a_repeat_asks_for_its_reads_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            asked.add(b.num_rows)
            yield b

    rows = [("s", i, ["CGG"] * (5 + i % 3), "spanning", "both") for i in range(30)]
    schema = "sample string, id long, units array<string>, class string, anchored string"
    reads = spark.createDataFrame(rows, schema).mapInArrow(seen, schema)
    assert repeats.repeat_consensus(reads, ["sample"]).first()["used"] == 30
    assert asked.value == 30


def test_all_reads_of_a_repeat_vote(spark):
    """The 300 reads taken evenly by size, as before, are without the many that read otherwise (F13)."""
    some, others = ["CGG"] * 4 + ["AGG"] + ["CGG"] * 4, ["CGG"] * 9
    # every third of 900 reads of one size says the one, so that a walk in steps of about three meets it alone
    rows = [("s", i, some if i % 3 == 0 else others, "spanning", "both") for i in range(898)]
    got = repeats.repeat_consensus(spark.createDataFrame(rows, "sample string, id long, units array<string>, class string, anchored string"), ["sample"], ["AGG"]).first()
    assert (got["used"], got["listed"], got["structure"], got["interruptions"]) == (898, 898, "(CGG)9", "")
    assert abs(got["mean_support"] - (8 + 598 / 898) / 9) < 1e-9


def test_variants_count_reads_that_are_alike_once(spark):
    ops = [{"op": o, "n": n} for o, n in (("M", 12), ("D", 2), ("M", 7), ("X", 1), ("M", 4))]
    schema = "contig string, start int, ops array<struct<op:string,n:int>>, seq string"
    rows = [("c", 100 + i % 2, ops, "A" * 19 + "CAAAA") for i in range(30)]
    plain = variants.called_variants(spark.createDataFrame(rows, schema), ["contig"], 0.01)
    assert "count(1)" in plan(plain).split("Generate")[-1]
    two = spark.createDataFrame([(*rows[0], 15), (*rows[1], 15)], f"{schema}, lines long")
    want = sorted(map(tuple, plain.collect()))
    assert want == sorted(map(tuple, variants.called_variants(two, ["contig"], 0.01, weight="lines").collect()))
    assert {(r[1], r[2]): r[5:7] for r in want}[112, "del"] == (15, 30)


def test_rescued_clips_ask_for_their_ends_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            asked.add(b.num_rows)
            yield b

    tiles = spark.createDataFrame([("c", i, "ACGTTGCAAGCTTAGC" * 2) for i in range(20)], "contig string, tile int, seq string")
    schema = "contig string, id long, pos int, side string, seq string, hard boolean, n int"
    ref = "ACGTTGCAAGCTTAGC" * 40
    rows = [("c", i, 100 + i % 3, "right", ref[300 + i % 3 : 320 + i % 3], False, 20) for i in range(30)] + [("c", 99, 100, "right", "A" * 20, False, 20)]
    ends = spark.createDataFrame(rows, schema).mapInArrow(seen, schema)
    points = spark.createDataFrame([("c", "split", 100, 300)], "contig string, kind string, s int, e int")
    assert sorted(r["id"] for r in rescue.rescued(ends, points, tiles, "contig", 32).collect()) == list(range(30))
    assert asked.value == 31


def test_tandem_copies_ask_for_their_groups_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            asked.add(b.num_rows)
            yield b

    schema = "contig string, pos int, len int, seq string, reads long"
    tiles = spark.createDataFrame([("c", i, "ACGTTGCAAGCTTAGC" * 2) for i in range(20)], "contig string, tile int, seq string")
    groups = spark.createDataFrame([("c", 300, 60, "AC" * 30, 1), ("c", 400, 60, "GT" * 30, 2)], schema).mapInArrow(seen, schema)
    assert rescue.tandem_copies(groups, tiles, "contig", 32).count() == 2
    assert asked.value == 2


def test_fates_of_events_alike_and_of_what_no_event_touches_make_no_fragments(spark, tmp_path, monkeypatch):
    spark.read.parquet(f"{SF}/sf0.001/part.parquet").where("p_partkey < 200").write.parquet(f"{tmp_path}/part.parquet")
    rows = []
    monkeypatch.setattr(derivatives, "store", lambda df, name, f=derivatives.store: (rows.append((name, (out := f(df, name)).count())), out)[1])

    def fates(keys):
        spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.mode("overwrite").parquet(f"{tmp_path}/supplier.parquet")
        rows.clear()
        got = sorted(tuple(r) for r in rebuilt.QUERIES["h06_transcript_fates"](spark, str(tmp_path)).collect())
        return got, dict(rows)

    keys = [0, 1, 20, 21, 40, 41]
    once, held = fates(keys)
    again, held_again = fates([k + n for n in (0, 3000, 6000) for k in keys])
    assert held_again == held and 0 < held["fragments"] < len(once) / 4
    assert len({kind for _, _, kind, *_ in once}) > 3 and len(again) == 3 * len(once)
    of = lambda n: [(f"{int(e.split('-')[0]) - n}-{e.split('-')[1]}", *r) for e, *r in again if n <= int(e.split("-")[0]) < n + 3000]
    assert all(sorted(of(n)) == once for n in (0, 3000, 6000))


def test_fragments_with_alleles_are_dealt_once(spark):
    q = rebuilt.QUERIES["e36_tolerant_groups"](spark, f"{SF}/sf0.001")
    lines = [x.lstrip(" :+-") for x in q._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines()]
    assert "l_orderkey" not in plan(q) and sum(x.startswith("Exchange hashpartitioning") for x in lines) == 1


def test_lines_of_fragments_are_joined_once_and_dealt(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(phased, "store", lambda df, name, f=phased.store: (written.update({name: plan(df)}), f(df, name))[1])
    q = phased.QUERIES["e40_phase_blocks"](spark, f"{SF}/sf0.001")
    assert "l_orderkey" not in plan(q) and set(written) == {"fragment-alleles", "links"}
    assert all("RepartitionByExpression [contig" in x for x in written.values()) and "l_orderkey" not in written["links"]
    assert q.count() == q.select("contig", "site").distinct().count() > 0


def test_lab_entries_inside_an_earlier_one_are_not_met(spark, monkeypatch):
    """(F9)"""
    held = []
    monkeypatch.setattr(cgh, "store", lambda df, name, f=cgh.store: held.append(f(df, name)) or held[-1], raising=False)
    rng = random.Random(4)
    kinds, both = ("loss", "gain", "loh"), ("loss", "gain", "both")
    calls = [(i, rng.choice("12"), rng.choice(kinds), s := rng.randrange(9000), s + rng.randint(-1, 400)) for i in range(300)] + [(7, "1", "loss", 50, 90), (8, "1", "gain", 0, 0)]
    lab = [(rng.randrange(500), rng.choice("12"), s := rng.randrange(9000), s + rng.randint(-1, 500), rng.choice(both)) for _ in range(900)]
    got = cgh.lab_matches(spark.createDataFrame(calls, "call long, chrom string, kind string, s int, e int"), spark.createDataFrame(lab, "entry long, chrom string, ls int, le int, type string"))
    want = {}
    for call, chrom, kind, s, e in calls:
        for entry, c, ls, le, of in lab:
            n = min(e, le) - max(s, ls) + 1
            if c == chrom and of in (kind, "both") and n > 0 and n / (e - s + 1) >= 0.8:
                want[call] = max(want.get(call, (0, 0)), (n / (e - s + 1), -entry))
    assert {r["call"]: (r["pct"], -r["entry"]) for r in got.collect()} == want
    assert len(held) == 1 and 0 < held[0].count() < 600


def test_transcripts_inside_a_better_one_of_their_gene_are_not_met(spark, monkeypatch):
    """(F2)"""
    held = []
    monkeypatch.setattr(annotation, "store", lambda df, name, f=annotation.store: held.append(f(df, name)) or held[-1], raising=False)
    rng = random.Random(5)
    calls = [(i, rng.choice("12"), s := rng.randrange(5000), s + rng.randint(0, 600)) for i in range(150)] + [(7, "1", 50, 900), (7, "2", 50, 900)]
    tx = [(k, rng.choice("gh"), rng.choice("12"), a := rng.randrange(5000), a + rng.randint(1, 500), rng.random() < 0.3) for k in range(500)]
    parts = [(k, g, c, x, min(b, x + 30)) for k, g, c, a, b, _ in tx for x in (a, max(a, b - 20))]
    got = annotation.genes_of_calls(
        spark.createDataFrame(calls, "call int, chrom string, s int, e int"), spark.createDataFrame(tx, "tx int, symbol string, chrom string, a int, b int, listed boolean"), spark.createDataFrame(parts, "tx int, symbol string, chrom string, xs int, xe int")
    )
    best, touched = {}, set()
    for call, c, s, e in calls:
        for k, g, c2, a, b, listed in tx:
            if c == c2 and s < e and a < e and s < b:
                best[call, g] = min(best.get((call, g), (2,)), (not listed, a - b, k, a >= s and b <= e))
        touched |= {(call, g) for _, g, c2, xs, xe in parts if c == c2 and s < e and xs < e and s < xe}
    assert sorted(map(tuple, got.collect())) == sorted((call, g, k, whole, (call, g) in touched) for (call, g), (_, _, k, whole) in best.items())
    assert len(held) == 1 and 0 < held[0].count() < 300


def test_regions_that_share_much_are_looked_for_first(spark, monkeypatch):
    """(F7)"""
    held = []
    monkeypatch.setattr(cgh, "store", lambda df, name, f=cgh.store: held.append(f(df, name)) or held[-1], raising=False)
    rng = random.Random(6)
    calls = [(i, rng.choice("12"), s := rng.randrange(300), s + rng.randint(0, 60)) for i in range(80)] + [(7, "1", 50, 90), (7, "2", 50, 91)]
    regions = [(k, rng.choice("12"), s := rng.randrange(300), s + rng.randint(0, 60)) for k in range(900)] + [(k, "1", 50, 90) for k in range(900, 910)]
    got = cgh.recurrent(spark.createDataFrame(calls, "call int, chrom string, s int, e int"), spark.createDataFrame(regions, "region int, chrom string, rs int, re int"))
    hits = {}
    for call, c, s, e in calls:
        for k, c2, rs, re in regions:
            n = min(e, re) - max(s, rs)
            if c == c2 and n > 0 and 2 * n >= re - rs and 2 * n >= e - s:
                hits.setdefault(call, []).append((-min(n / (re - rs), n / (e - s)), k))
    assert sorted((r["call"], -min(r["of_region"], r["of_call"]), r["region"]) for r in got.collect()) == sorted((c, *h) for c, x in hits.items() for h in sorted(x)[:4])
    assert len(held) == 3 and held[0].count() > 0


@pytest.mark.parametrize("name", ["d10_dgv_hits", "d09_population_matches"])
def test_pairs_are_handed_out_where_they_meet(spark, name):
    """Nothing that is a pair is shuffled (F1, F6)."""
    lines = [x.lstrip(" :+-") for x in ALIKE[name].QUERIES[name](spark, f"{SF}/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()]
    met = next(i for i, x in enumerate(lines) if "Join" in x)
    assert not any(x.startswith("Exchange") for x in lines[:met]) and "_bin" in lines[met] and "_class" in lines[met]


def test_recurrence_neither_broadcasts_nor_shuffles_what_is_found(spark):
    """(F5)"""
    lines = [x.lstrip(" :+-") for x in basics.QUERIES["d08_recurrence"](spark, f"{SF}/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()]
    met = next(i for i, x in enumerate(lines) if "Join" in x)
    assert lines[met].startswith("SortMergeJoin") and not any(x.startswith("Exchange") for x in lines[:met]) and not any(x.startswith("Broadcast") for x in lines)


def test_places_of_pairs_take_one_shuffle_of_them(spark):
    """(F3)"""
    lines = [x.lstrip(" :+-") for x in rules.QUERIES["f05_population_order"](spark, f"{SF}/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()]
    met = next(i for i, x in enumerate(lines) if "Join" in x)
    assert "_class" in lines[met] and sum(x.startswith("Exchange") for x in lines[:met]) == 1
