"""Operators without SQL against brute force: ordered matching, balanced samples, medoids; and what SQL doesn't reach of hints and snapshots."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tempora.functions import hints as H
from tempora.operators import clusters as C
from tempora.operators import grouping as G
from tempora.operators import matching as M
from tempora.operators import rounds as R


def stretch(rng, k, anchored=False):
    start = round(rng.uniform(0, 30), 2)
    row = {"id": k, "start": start, "end": round(start + rng.uniform(0.5, 6), 2)}
    return row | {"anchor": round(rng.uniform(row["start"], row["end"]), 2)} if anchored else row


def test_ordered_pairs_are_the_best():
    """Of all ways to pair in order, as many as can be and the cheapest."""
    rng = random.Random(5)
    for _ in range(60):
        segments = sorted((stretch(rng, k) for k in range(rng.randint(0, 4))), key=lambda s: s["start"])
        cycles = sorted((stretch(rng, k, True) for k in range(rng.randint(0, 5))), key=lambda c: c["anchor"])
        n = min(len(segments), len(cycles))
        cost = lambda pairs: sum(M.assignment_cost(segments[i], cycles[j]) for i, j in pairs)
        every = [list(zip(a, b)) for a in itertools.combinations(range(len(segments)), n) for b in itertools.combinations(range(len(cycles)), n)]
        got = M.ordered_pairs(segments, cycles)
        assert len(got) == n and cost(got) == pytest.approx(min(map(cost, every)))


def test_matches_of_many_keys(spark):
    rng = random.Random(6)
    segments = [(k % 7, s["id"], s["start"], s["end"]) for k in range(40) for s in [stretch(rng, k)]]
    cycles = [(k % 7, c["id"], c["start"], c["end"], c["anchor"] if k % 3 else None) for k in range(60) for c in [stretch(rng, k, True)]]
    a, b = spark.createDataFrame(segments, "key long, id long, start double, end double"), spark.createDataFrame(cycles, "key long, id long, start double, end double, anchor double")
    for operator, kernel in ((M.match_in_order, M.ordered_pairs), (M.match_greedily, M.sequential_pairs)):
        want = set()
        for key in range(7):
            s = sorted(({"id": i, "start": x, "end": y} for k, i, x, y in segments if k == key), key=lambda r: (r["start"], r["end"], r["id"]))
            c = sorted(({"id": i, "start": x, "end": y, "anchor": (x + y) / 2 if z is None else z} for k, i, x, y, z in cycles if k == key), key=lambda r: (r["anchor"], r["id"]))
            want |= {(key, s[i]["id"], c[j]["id"]) for i, j in kernel(s, c)}
        assert {(r.key, r.segment_id, r.cycle_id) for r in operator(a, b, ["key"]).collect()} == want


def test_balanced_sample_is_greedy(spark):
    """What is cut before the picks are made changes none of them."""
    import hashlib

    rng = random.Random(7)
    rows = [(k, f"a{k % 2}", rng.choice([None, 0, 1, 2, 3]), f"v{int(rng.expovariate(0.3))}") for k in range(400)]
    for size in (1, 5, 12, 60):
        got = {r.id: r.pick for r in M.balanced_sample(spark.createDataFrame(rows, "id long, action string, score int, video string"), "action", "score", "video", "id", size, 3).collect()}
        want = {}
        for action in ("a0", "a1"):
            named = [{"id": i, "score": "unlabeled" if s is None else str(s), "source": v, "tie": hashlib.sha256(f"3:{a}:{i}".encode()).hexdigest()} for i, a, s, v in rows if a == action]
            want |= {r["id"]: n for n, r in enumerate(M.balanced_picks(named, size), 1)}
        assert got == want


def plain_medoids(ids, d, k):
    mean = lambda a, of: sum(d[a, b] for b in of if b != a) / max(1, len(of) - 1)
    medoids = [min(ids, key=lambda a: (round(mean(a, ids), 9), a))]
    while len(medoids) < min(k, len(ids)):
        rest = [a for a in ids if a not in medoids]
        medoids.append(max(rest, key=lambda a: (round(min(d[a, m] for m in medoids), 9), -a)))
    for _ in range(20):
        own = {a: min(medoids, key=lambda m, a=a: (d[a, m], m)) for a in ids}
        new = [min((a for a in ids if own[a] == m), key=lambda a, m=m: (round(mean(a, [b for b in ids if own[b] == m]), 9), a)) for m in medoids]
        if new == medoids:
            break
        medoids = new
    return {a: min(medoids, key=lambda m, a=a: (d[a, m], m)) for a in ids}


def test_medoids(spark):
    rng = random.Random(8)
    points = {(g, k): (rng.gauss(3 * (k % 3), 0.6), rng.gauss(0, 1), f"s{k % 4}") for g in range(3) for k in range((30, 7, 3)[g])}
    rows = spark.createDataFrame([(g, k, s) for (g, k), (_, _, s) in points.items()], "g long, id long, source string")
    near = [(g, a, b, ((points[g, a][0] - points[g, b][0]) ** 2 + (points[g, a][1] - points[g, b][1]) ** 2) ** 0.5) for g in range(3) for a, b in itertools.combinations([k for h, k in points if h == g], 2)]
    pairs = spark.createDataFrame(near, "g long, a long, b long, distance double")
    got = {(r.g, r.id): r.profile for r in C.k_medoids(rows, pairs, ["g"], "id").collect()}
    left_out = {(r.g, r.source): r.agreement for r in C.leave_one_out(rows, pairs, ["g"], "id", "source").collect()}
    for g in range(3):
        ids = [k for h, k in points if h == g]
        d = {(a, b): x for h, a, b, x in near if h == g} | {(b, a): x for h, a, b, x in near if h == g} | {(a, a): 0.0 for a in ids}
        own = plain_medoids(ids, d, C.group_count(len(ids)))
        names = {m: f"profile_{n}" for n, m in enumerate(sorted(set(own.values())), 1)}
        assert {k: got[g, k] for k in ids} == {k: names[m] for k, m in own.items()}
        for source in {s for (h, _), (_, _, s) in points.items() if h == g}:
            rest = [k for k in ids if points[g, k][2] != source]
            if len(rest) > 1:
                new = plain_medoids(rest, d, C.group_count(len(rest)))
                same = [(own[a] == own[b]) == (new[a] == new[b]) for a, b in itertools.combinations(rest, 2)]
                assert left_out[g, source] == pytest.approx(sum(same) / len(same))


def test_numerals(spark):
    said = {"7": 7, "12": 12, "三": 3, "两": 2, "十": 10, "十二": 12, "三十": 30, "四十五": 45, "x": None}
    rows = spark.createDataFrame([(k,) for k in said], "t string").select("t", H.numeral(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == said


def test_folded(spark):
    text = "  École d'Été &amp; Function Movement Screen—Push-Up ASSESSMENT (2) "
    assert spark.createDataFrame([(text,)], "t string").select(H.folded(F.col("t"))).first()[0] == "ecole d ete and fms push up test 2"


def test_snapshots_are_ingested_once(spark, tmp_path):
    a, b = spark.range(5).withColumn("x", F.col("id") * 2), spark.range(3)
    path, keys = f"file://{tmp_path}/s", {"a": "id", "b": "id"}
    first = R.ingest_snapshot(spark, path, {"a": a, "b": b}, keys)
    assert first[1] and R.ingest_snapshot(spark, path, {"b": b.repartition(2), "a": a.orderBy(F.desc("id"))}, keys) == (first[0], False)
    other, written = R.ingest_snapshot(spark, path, {"a": a.withColumn("x", F.col("x") + 1), "b": b}, keys)
    assert written and other != first[0]
    assert {r.snapshot_id: r["count"] for r in spark.read.parquet(f"{path}/a").groupBy("snapshot_id").count().collect()} == {first[0]: 5, other: 5}


def test_feature_values(spark):
    rows = spark.createDataFrame([(1, "squat", {"depth": 0.12345678, "lean": float("nan")}), (2, "lunge", {"depth": 1.0}), (3, "other", {})], "id long, action string, m map<string,double>")
    made = R.feature_values(rows, {"squat": ["depth", "lean"], "lunge": ["drift"]}, "action", "m")
    assert {r.id: r.features for r in made.collect()} == {1: {"depth": 0.123457, "lean": None}, 2: {"drift": None}, 3: None}
    assert R.feature_names(made) == ["depth", "drift", "lean"]


def cycle(start, end, strength=1.0, side="left", anchor=None):
    return {"start": start, "end": end, "anchor": (start + end) / 2 if anchor is None else anchor, "strength": strength, "visibility": None, "side": side}


def spans(cycles):
    return [(c["start"], c["end"]) for c in cycles]


def test_halves_are_paired():
    halves = [cycle(0, 2), cycle(3, 5), cycle(9, 11, side="right"), cycle(12, 14, side="right")]
    assert spans(G.to_count(halves, 2)) == [(0, 6.2), (9, 15.2)]
    assert len(G.to_count(halves, 4)) == 4


def test_whole_cycles_are_taken_from_the_first():
    assert spans(G.to_count([cycle(10, 14), cycle(0, 4), cycle(5, 8.5)], 2)) == [(0, 5), (5, 10)]


def test_short_cycles_join_their_shorter_neighbour():
    got = G.to_count([cycle(0, 4), cycle(4.5, 6.5, 3.0), cycle(7, 9.5), cycle(20, 25)], 3)
    assert spans(got) == [(0, 4), (4.5, 9.5), (20, 25)] and got[1]["strength"] == 3.0
    assert spans(G.to_count([cycle(0, 4, 2), cycle(5, 9, 1, "right"), cycle(10, 14, 3), cycle(15, 16.7, 4, "right")], 2)) == [(0, 4), (10, 16.7)]


def test_noise_goes_if_enough_is_left():
    noisy = [cycle(0, 4), cycle(5, 6), cycle(7, 11)]
    assert len(G.to_count(noisy, 2)) == 2 and spans(G.to_count(noisy, 2)) == [(0, 5.2), (7, 12.2)]
    assert spans(G.to_count(noisy, 0)) == [(0, 4), (5, 6), (7, 11)]


def test_cycles_to_count_of_keys(spark):
    rows = [(k % 2, float(s), float(s + 3 + k % 3), float(s + 1), 1.0 + k % 5, 0.5, "left") for k, s in enumerate(range(0, 60, 5))]
    cycles = spark.createDataFrame(rows, "key long, start double, end double, anchor double, strength double, visibility double, side string")
    got = G.cycles_to_count(cycles, spark.createDataFrame([(0, 3)], "key long, expected long"), ["key"]).collect()
    assert sorted((r.key, r.number) for r in got) == [(0, 1), (0, 2), (0, 3), *((1, n) for n in range(1, 7))]
