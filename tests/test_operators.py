"""Operators on small made-up inputs: sources, sinks, streams, frames, detectors, matching."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tempora.functions import scalars as X
from tempora.operators import detectors as D
from tempora.operators import frames as P
from tempora.operators import joins as J
from tempora.operators.constraints import prohibited_fields
from tempora.sources import readers, writers
from tempora.streaming import views


def test_frames_to_cycles(spark, tmp_path):
    """Two bends of a body, at 3 and 8 seconds, read from JSON, are two cycles."""
    pulse = lambda t: max(0.0, 1 - abs(t - 3) / 1.2, 1 - abs(t - 8) / 1.2)

    def frame(k):
        t = k / 5
        y = {"shoulder": 0.2, "hip": 0.2 + 0.6 * (0.42 + 0.28 * pulse(t)), "ankle": 0.8}
        points = [{"name": f"{side}_{n}", "x": 0.5, "y": v, "z": 0.0, "visibility": 0.9} for n, v in y.items() for side in ("left", "right")]
        return {"number": k, "second": t, "subjects": [{"position": 0, "points": points}, {"position": 1, "points": points[:1]}]}

    (tmp_path / "a.json").write_text(json.dumps({"id": "v", "frames": [frame(k) for k in range(61)] + [{"number": 99, "second": None, "subjects": []}]}))
    (tmp_path / "b.json").write_text("{bad")
    (tmp_path / "c.json").write_text("{}")
    from pyspark.sql.types import _parse_datatype_string

    docs, issues = readers.json_files(spark, f"file://{tmp_path}", _parse_datatype_string(P.DOCUMENT), "id")
    assert sorted(r.issue for r in issues.collect()) == ["missing_id", "unreadable"]
    subjects = P.subject_rows(P.frame_rows(docs, "id"), "id").where("position = 0")
    y = lambda n: P.mean_of(P.usable(F.col("points"), 0.35), [f"left_{n}", f"right_{n}"], "y")
    signal = subjects.select("id", "second", P.depth_ratio(y("shoulder"), y("hip"), y("ankle")).alias("depth"))
    how = D.Cycling(before=0.0, after=0.0)
    found = D.cycles(signal, ["id"], "second", "depth", how).orderBy("anchor").collect()
    assert [round(r.anchor) for r in found] == [3, 8]
    assert all(r.start < r.anchor < r.end and r.end - r.start < 4 for r in found)
    still = signal.withColumn("depth", F.lit(0.4))
    assert D.cycles(still, ["id"], "second", "depth", how).collect() == []
    moving = signal.withColumn("move", F.when(F.col("second").between(4, 8), 0.05).otherwise(0.001))
    periods = D.active_periods(moving, ["id"], "second", "move").collect()
    assert len(periods) == 1 and periods[0].start == pytest.approx(3.2, abs=0.6) and periods[0].end == pytest.approx(9.0, abs=0.6)


def test_points(spark):
    row = spark.createDataFrame([([("nose", 0.5, 0.25, 0.1, 0.9), ("ear", float("nan"), 0.1, 0.0, None), ("eye", 0.1, 0.1, 0.0, 0.1)],)], f"points array<{P.POINT}>")
    got = row.select(P.overlay(F.col("points")).alias("o"), P.point(F.col("points"), "eye").alias("e"), P.point(F.col("points"), "toe").alias("t"), P.remapped(F.col("points"), F.lit(0.5), F.lit(0.0), F.lit(1.0), F.lit(0.5)).alias("m")).first()
    assert {k: tuple(v) for k, v in got.o.items()} == {"nose": (50.0, 25.0)} and got.e.x == 0.1 and got.t is None
    assert (got.m[0].x, got.m[0].y, got.m[0].z) == (0.75, 0.125, 0.05)


@pytest.mark.parametrize(("strategy", "best"), [("left", 0), ("right", 2), ("center", 1), ("largest", 1), ("region", 2), ("first", 0)])
def test_subject_choice(spark, strategy, best):
    boxes = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.2, 0.5, 0.9), (1, 1, 0.35, 0.0, 0.65, 0.6, 0.9), (1, 2, 0.8, 0.0, 1.0, 0.5, 0.9)], "f int, position int, x1 double, y1 double, x2 double, y2 double, seen double")
    score = P.subject_score(strategy, *map(F.col, ("x1", "y1", "x2", "y2", "seen", "position")), region=(0.75, 0.0, 1.0, 1.0))
    assert P.primary_subject(boxes, ["f"], score).first().position == best


def test_readers_and_signed_output(spark, tmp_path):
    (tmp_path / "m.csv").write_text('name,start,note\n# a comment\n a , 1.5 ,"x ""y"", z"\n')
    assert [tuple(r) for r in readers.manifest(spark, f"file://{tmp_path}/m.csv", ["name", "start", "note"]).collect()] == [("a", "1.5", 'x "y", z')]
    named = {r.name: r.sha256 for r in writers.signed(spark.range(5).repartition(2), f"file://{tmp_path}/out").collect()}
    assert len(named) == 2
    for name, digest in named.items():
        assert hashlib.sha256((tmp_path / "out" / name).read_bytes()).hexdigest() == digest
    first, *_ = sorted(named)
    (tmp_path / "sums").write_text("".join(f"{d}  {n}\n" for n, d in named.items()) + f"{'0' * 64}  gone\n")
    (tmp_path / "out" / first).write_text("changed")
    (tmp_path / "out" / f".{first}.crc").unlink()
    (tmp_path / "out" / "new.json").write_text("{}")
    status = {r.name: r.status for r in readers.verified(spark, f"file://{tmp_path}/out", readers.checksums(spark, f"file://{tmp_path}/sums")).collect()}
    assert (status[first], status["gone"], status["new.json"]) == ("changed", "missing", "unlisted") and list(status.values()).count("ok") == 1


def test_append_is_idempotent(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    batch = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "event_id long, content_hash string")
    assert [writers.append_events(batch, log) for _ in range(2)] == [2, 0]
    with pytest.raises(ValueError, match="another content"):
        writers.append_events(spark.createDataFrame([(1, "z"), (3, "c")], batch.schema), log)
    assert spark.read.parquet(log).count() == 2


def test_streams_equal_batches(spark, tmp_path):
    rows = [(k % 3, k, f"2024-01-01 00:{k:02d}:00", f"h{k}") for k in range(40)]
    df = spark.createDataFrame(rows, "key int, event_id int, ts string, content_hash string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(4).write.parquet(f"file://{tmp_path}/in")
    stream = views.event_stream(spark, f"file://{tmp_path}/in", df.schema, files=1)
    run = lambda out, name, mode: out.writeStream.format("memory").queryName(name).outputMode(mode).start().processAllAvailable()
    run(views.latest_by_key(stream, "key", "ts", "event_id", ["event_id"]), "newest", "complete")
    want = views.last_of_batch(df, "key", "ts", "event_id")
    assert {(r.key, r.event_id) for r in spark.table("newest").collect()} == {(r.key, r.event_id) for r in want.collect()}
    run(views.windowed_counts(stream, "ts", "10 minutes", "1 hour"), "windows", "complete")
    assert sorted(r.n for r in spark.table("windows").collect()) == [10] * 4
    run(views.session_counts(stream, "ts", "5 minutes", "1 hour", "key"), "sessions", "complete")
    assert sorted(r.n for r in spark.table("sessions").collect()) == [13, 13, 14]
    for _ in range(2):
        views.ingest(stream, f"file://{tmp_path}/log", f"file://{tmp_path}/check{_}").start().awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/log").count() == 40
    for q in spark.streams.active:
        q.stop()


def test_must_match_raises(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(Exception, match="no partner"):
        J.must_match(left, right, ["k"]).collect()


def test_scalars(spark):
    got = spark.range(1).select(
        X.frame_rate(F.lit("30000/1001")).alias("a"), X.frame_rate(F.lit("1/0")).alias("b"), X.iso_seconds(F.lit("PT1H2M3.5S")).alias("c"), X.iso_seconds(F.lit("x")).alias("d"),
        X.fnv1a(F.lit("ab")).alias("e"), X.half_up(F.lit(-2.5)).alias("f"), X.axial_difference(F.lit(170.0), F.lit(5.0)).alias("g"), X.finite(F.lit(float("nan"))).alias("h"),
        X.line_distance(F.lit(0.0), F.lit(1.0), F.lit(-1.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("i"),
    ).first()
    assert got.a == pytest.approx(29.97003) and got.b is None and got.c == 3723.5 and got.d is None and got.e == 1294271946 and got.f == -2 and got.g == 15 and got.h is None and got.i == 1


def test_prohibited_fields(spark):
    df = spark.createDataFrame([], "a int, b struct<score:int, c array<struct<label_x:int>>>, m map<string, struct<score:int>>")
    assert prohibited_fields(df, "score|label") == ["b.score", "b.c.label_x", "m.score"]


# ---- rules that were once departed from


def test_completion_of_many_reviewers(spark):
    from tempora.operators.rounds import completion

    expected = spark.createDataFrame([(k,) for k in range(3)], "id long")
    done = [(r, k, "scored" if k else "unscorable") for r in range(1500) for k in range(3)]
    odd = [(2000, 0, "scored"), (2000, 1, "scored"), (2001, 0, "scored"), (2001, 1, "scored"), (2001, 2, "deferred"), (2002, 0, "scored"), (2002, 1, "scored"), (2002, 2, "scored"), (2002, 9, "scored"), (2003, 9, "deferred")]
    reviews = spark.createDataFrame(done + odd, "reviewer long, id long, status string")
    got = {r.reviewer: r for r in completion(expected, reviews, "id", ["reviewer"]).collect()}
    assert len(got) == 1504 and all(got[r].complete and got[r].expected == 3 and got[r].missing == 0 for r in range(1500))
    said = {r: (got[r].reviewed, got[r].scored, got[r].deferred, got[r].missing, got[r].unexpected, got[r].complete) for r in range(2000, 2004)}
    assert said == {2000: (2, 2, 0, 1, 0, False), 2001: (3, 2, 1, 0, 0, False), 2002: (3, 4, 0, 0, 1, False), 2003: (0, 0, 1, 3, 1, False)}
    assert not any(r.complete for r in completion(expected.limit(0), reviews, "id", ["reviewer"]).collect())
    assert completion(expected, reviews.limit(0), "id", ["reviewer"]).collect() == []


@pytest.mark.parametrize(("attempts", "final"), [
    ([(3, False), (1, True)], (3, "final_ready", "floor_attempt_earned_three")), ([(2, False), (2, True)], (2, "final_ready", "heel_elevated_attempt_earned_two")), ([(2, False), (1, True)], (1, "final_ready", "heel_elevated_attempt_below_two")),
    ([(2, False), (None, True)], (None, "needs_heel_elevated_attempt", "floor_attempt_no_three_needs_board")), ([(None, True)], (None, "insufficient_evidence", "no_scorable_attempts")), ([(3, False), (0, True)], (0, "pain_zero", "pain_or_clearing_zero")),
    ([(2, None)], (None, "needs_heel_elevated_attempt", "floor_attempt_no_three_needs_board")),
])
def test_staged_score(spark, attempts, final):
    from tempora.operators.scoring import staged_score

    r = staged_score(spark.createDataFrame([("a", *x) for x in attempts], "k string, score int, raised boolean"), ["k"], "score", F.col("raised")).first()
    assert (r.final_score, r.status, r.reason) == final and (r.attempts, r.scorable) == (len(attempts), sum(s is not None for s, _ in attempts))


def test_source_effect(spark):
    """Pairs within a source at half the distance of those between: a strong signature, not a weak one."""
    from tempora.operators.clusters import source_effect

    sources = spark.createDataFrame([("a", k, k // 2) for k in range(4)], "g string, id int, source int")
    pairs = [("a", a, b, 0.5 if a // 2 == b // 2 else 1.0) for a in range(4) for b in range(a + 1, 4)]
    r = source_effect(spark.createDataFrame(pairs, "g string, a int, b int, distance double"), sources, ["g"], "id", "source").first()
    assert (r.within_pairs, r.between_pairs, r.within, r.between, r.ratio, r.signature) == (2, 4, 0.5, 1.0, 0.5, "strong_source_video_signature")


def test_merged_periods_average_pair_by_pair(spark):
    from tempora.operators.sequences import merged_periods

    rows = [("a", 0.0, 1.0, 0.2, 0.5), ("a", 1.5, 2.0, 0.4, 0.9), ("a", 2.1, 2.2, None, None), ("a", 2.5, 3.0, 0.8, 0.1), ("a", 9.0, 9.5, 0.3, None)]
    got = merged_periods(spark.createDataFrame(rows, "k string, start double, end double, mean double, peak double"), ["k"], 1.6, "mean", "peak").orderBy("start").collect()
    assert [(r.start, r.end, r.merged, r.peak) for r in got] == [(0.0, 3.0, 4, 0.9), (9.0, 9.5, 1, 0.0)]
    assert got[0].mean == pytest.approx(((0.2 + 0.4) / 2 + 0.8) / 2) and got[1].mean == 0.3


def test_folding_of_other_letters(spark):
    """Against the same rules letter by letter, for all letters that come apart."""
    import re
    import unicodedata

    from tempora.functions.hints import folded

    texts = ["őű Şirin čeština", "ﬁt ﬂow ½ ㎏", "ＦＵＬＬ　ｗｉｄｔｈ", "Việt Nam ấ", "日本 x", "", None, "İstanbul", *[f"a{chr(c)}b" for c in range(0x80, 0x2FF)]]
    plain = lambda t: re.sub(r"[^a-z0-9]+", " ", re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFKD", t or "")).lower()).strip()
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(folded(F.col("t"))).collect()]
    assert got == [plain(t) for t in texts]


def test_similar_titles_of_an_action(spark):
    from tempora.operators.joins import similar_titles

    left = spark.createDataFrame([("deep squat practice", "squat")], "title string, wanted string")
    right = spark.createDataFrame([("my deep squat practice one", k) for k in ("squat", "lunge", "unknown", None)], "other string, kind string")
    assert {r.kind for r in similar_titles(left, right, "title", "other", action=("wanted", "kind")).collect()} == {"squat", "unknown"}
    assert similar_titles(left, right, "title", "other").count() == 4


def test_snapshot_of_repeated_keys(spark, tmp_path):
    from tempora.operators.rounds import ingest_snapshot

    with pytest.raises(ValueError, match="repeats"):
        ingest_snapshot(spark, str(tmp_path), {"a": spark.createDataFrame([(1,), (1,)], "id long")}, {"a": "id"})
    assert not list(tmp_path.iterdir())


# ---- notes


NOTES = [
    ("第二个正面，rep 3 side", 4, [None, "front", "side", None], []), ("一到三正面，4-5侧面", 6, ["front"] * 3 + ["side"] * 2 + [None], []), ("前三个正面，后四个侧面", 7, ["front"] * 3 + ["side"] * 4, []),
    ("first 2 reps front, last 1 side", 5, ["front"] * 2 + ["side"] * 3, []), ("last 9 from the front", 3, ["front"] * 3, []), ("第2个侧面，前三个正面", 4, ["front", "side", "front", None], []), ("5到3正面", 5, [None] * 5, []),
    ("rep 2-4 heels elevated; rep 6 fms board", 6, [None] * 6, [2, 3, 4, 6]), ("第一到第三个", 2, [None] * 2, []), ("第2到3个脚跟抬起", 4, [None] * 4, [2, 3]), ("2个到3个垫脚跟", 4, [None] * 4, [2, 3]),
    ("last two with heel lift", 5, [None] * 5, [4, 5]), ("all but the first heels raised", 3, [None] * 3, [2, 3]), ("除了第一个都脚跟垫高", 3, [None] * 3, [1, 2, 3]), ("其余脚跟垫高", 3, [None] * 3, [2, 3]), ("后两个垫高脚跟", 2, [None] * 2, [1, 2]), ("last two", 3, [None] * 3, []),
    (None, 2, [None] * 2, []), ("", 1, [None], []), ("前二十三个侧面", 2, ["side"] * 2, []),
]


def test_rules_of_notes(spark):
    from tempora.operators.notes import repetition_rules

    rows = [(k, notes, count) for k, (notes, count, _, _) in enumerate(NOTES)] + [(-1, "first 2 front", 0), (-2, "first 2 front", None)]
    got = repetition_rules(spark.createDataFrame(rows, "k int, notes string, n int"), ["k"], "notes", "n").orderBy("k", "repetition").collect()
    for k, (notes, count, views, raised) in enumerate(NOTES):
        own = [r for r in got if r.k == k]
        assert ([r.repetition for r in own], [r.view for r in own], [r.repetition for r in own if r.raised]) == (list(range(1, count + 1)), views, raised), notes
    assert min(r.k for r in got) == 0


# ---- chains


def test_chains_of_many_links(spark, monkeypatch):
    """A thousand links in about ten rounds; forks, a cycle with a tail, other groups, missing targets and repeated ids."""
    from tempora.operators import reviews as E

    rounds = []
    kept = E._kept
    monkeypatch.setattr(E, "_kept", lambda df: rounds.append(1) or kept(df))
    rows = [(k, k - 1 if k else None, "g") for k in range(1001)] + [(2000, 5, "g"), (2001, 4, "h"), (2002, 9999, "g"), (3000, 3001, "c"), (3001, 3002, "c"), (3002, 3000, "c"), (3003, 3000, "c"), (3004, 3004, "c"), (4000, None, "g"), (4000, 3, "g"), (4001, 4000, "g"), (None, 1, "g")]
    events = spark.createDataFrame(rows, "event_id int, target int, repetition_id string").repartition(4)
    found = E.chains(events, "event_id", "target", "repetition_id")
    got = {r.event_id: r for r in found.collect()}
    assert len(rounds) <= 14
    assert all((got[k].root, got[k].steps, got[k].status) == (0, k, "linked" if k else "first") for k in range(1001)) and [k for k in range(1001) if got[k].head] == [1000]
    assert [k for k in got if got[k].forked] == [6, 2000, 3002, 3003] or {k for k in got if got[k].forked} == {6, 2000, 3002, 3003}
    assert (got[2000].root, got[2000].steps, got[2001].status, got[2002].status, got[4001].status) == (0, 6, "other_group", "missing_target", "missing_target")
    assert {k for k in got if got[k].status == "cycle"} == {3000, 3001, 3002, 3003, 3004} and {k for k in got if got[k].status == "repeated_id"} == {4000, None}
    errors = {(r.event_id, r.error) for r in E.reference_errors(events, found, spark.createDataFrame([("g",), ("c",)], "repetition_id string")).collect()}
    assert (2001, "outside_manifest") in errors and (2002, "superseded_missing") in errors and (3004, "superseded_in_a_cycle") in errors and (2000, "superseded_twice") in errors and (4000, "event_id_repeats") in errors
    assert E.chains(events.limit(0), "event_id", "target", "repetition_id").collect() == []


def test_chains_in_few_steps(spark, monkeypatch):
    """Cycles take no further rounds, and groups that are too large for one task give the same rows."""
    from tempora.operators import reviews as E

    rng = random.Random(5)
    rows = [(n, rng.choice([None, rng.randrange(320), rng.randrange(320), n - n % 40 + rng.randrange(40)]), [None, "g", "h", "k"][n // 40 % 4]) for n in range(300)] + [(7, 8, "g"), (None, 1, "h"), (2**60 + 1, 2**60, "g"), (2**60, None, "g")]
    events = spark.createDataFrame(rows, "event_id long, target long, repetition_id string").repartition(3)
    calls, kept = [], E._kept
    monkeypatch.setattr(E, "_kept", lambda df: calls.append(1) or kept(df))
    near = E.chains(events, "event_id", "target", "repetition_id").collect()
    assert len(calls) <= 3
    monkeypatch.setattr(E, "GROUP", 70)
    far = E.chains(events, "event_id", "target", "repetition_id").collect()
    assert len(calls) > 6 and sorted(map(repr, near)) == sorted(map(repr, far)) and {r.status for r in near} == {"first", "linked", "missing_target", "other_group", "cycle", "repeated_id"}
    assert next((r.root, r.steps) for r in near if r.event_id == 2**60 + 1) == (2**60, 1)


def test_split_extrema_of_missing_and_tied(spark):
    """Rows without a time or a value are passed over as arg_max passes over them; of equal peaks the first counts."""
    import duckdb

    from tempora.operators import sequences as S

    rows = [(1, 1, 5.0), (1, 2, 9.0), (1, 3, 9.0), (1, 4, 1.0), (2, 1, None), (2, 2, None), (3, None, 8.0), (3, 2, 4.0), (3, 3, 2.0), (3, 1, 3.0), (4, None, 8.0), (5, 2, None), (5, 1, 1.0)]
    got = S.split_extrema(spark.createDataFrame(rows, "k long, t long, v double").repartition(3), ["k"], "t", "v").select("k", "peak_time", "peak", "least_before", "least_after")
    con = duckdb.connect()
    con.execute("CREATE TABLE r (i INT, k BIGINT, t BIGINT, v DOUBLE)")
    con.executemany("INSERT INTO r VALUES (?, ?, ?, ?)", [(i, *r) for i, r in enumerate(rows)])
    want = con.execute("SELECT k, pt, p, min(v) FILTER (t < pt), min(v) FILTER (t > pt) FROM r JOIN (SELECT k, arg_max(t, v ORDER BY t) AS pt, max(v) AS p FROM r GROUP BY 1) USING (k) GROUP BY 1, 2, 3").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_reference_errors_in_few_steps(spark, monkeypatch):
    """Errors of a chain of 600, of cycles and of ends elsewhere, with as many checkpoints as for a chain of one."""
    from tempora.operators import reviews as E

    rows = [(n, n - 1 if n else None, "g") for n in range(600)] + [(700, 701, "g"), (701, 700, "g"), (702, 700, "g"), (703, 9, "h"), (704, 999, "h"), (705, None, "x")]
    events = spark.createDataFrame(rows, "event_id long, target long, repetition_id string")
    calls, kept = [], E._kept
    monkeypatch.setattr(E, "_kept", lambda df: calls.append(1) or kept(df))
    expected = spark.createDataFrame([("g",), ("h",)], "repetition_id string")
    got = {(r.event_id, r.error) for r in E.reference_errors(events, E.chains(events, "event_id", "target", "repetition_id"), expected).collect()}
    cycle, forks = "superseded_in_a_cycle", {(701, "superseded_twice"), (702, "superseded_twice")}
    assert got == {(700, cycle), (701, cycle), (702, cycle), (703, "superseded_of_another_repetition"), (704, "superseded_missing"), (705, "outside_manifest")} | forks
    assert len(calls) <= 3


# ---- canonical entries


def test_assets_in_four_states(spark):
    from tempora.operators import canonical as C

    files = spark.createDataFrame([(p,) for p in ("/d/Deep Squat/a.MP4", "/d/squat/b.mp4", "/d/x/squat/b.mp4", "/d/sample videos/squat/c.mp4", "/d/squat/c.mp4", "/d/other/d.mp4", "C:\\d\\squat\\e.mp4", "/d/sample videos/g.mp4")], "path string")
    ranked = C.ranked_files(files, "path", {"squat": ("/squat/", "/deep squat/"), "lunge": ("/lunge/",)})
    asked = [("A.mp4", "squat"), ("b.mp4", "squat"), ("c.mp4", "squat"), ("d.mp4", "squat"), ("e.MP4", "squat"), (None, "squat"), ("", "squat"), ("a.mp4", "lunge"), ("zz.mp4", "squat"), ("g.mp4", None), ("g.mp4", "jump")]
    refs = spark.createDataFrame([(k, *a) for k, a in enumerate(asked)], "k int, name string, action string")
    got = [(r.asset_status, r.asset_path, r.asset_candidates) for r in C.resolved(refs, ranked, "name", "action", ["squat", "lunge"]).orderBy("k").collect()]
    assert got == [
        ("found", "/d/Deep Squat/a.MP4", 1), ("ambiguous", "/d/squat/b.mp4", 2), ("found", "/d/sample videos/squat/c.mp4", 1), ("missing", None, 1), ("found", "C:\\d\\squat\\e.mp4", 1), ("not_referenced", None, 0), ("not_referenced", None, 0),
        ("missing", None, 1), ("missing", None, 0), ("found", "/d/sample videos/g.mp4", 1), ("found", "/d/sample videos/g.mp4", 1),
    ]


def test_repeated_exports(spark):
    from tempora.operators import canonical as C

    rows = [("e1", "same", "b.json", 1, [("s", 0.0, 1.0)]), ("e1", "same", "a.json", 2, [("s", 0.0, 1.0), ("s", 0.0, 1.0)]), ("e2", "first", "a.json", 1, []), ("e2", "second", "b.json", 1, None)]
    occurrences = spark.createDataFrame(rows, "id string, content string, source string, at int, segments array<struct<segment_id:string,start:double,end:double>>")
    found = C.deduplicated(occurrences, "id", "content", "source", ["source", "at"])
    got = {r.id: (r.content, r["at"], r.occurrences, r.source_files, r.conflict) for r in found.collect()}
    assert got == {"e1": ("same", 2, 2, ["a.json", "b.json"], False), "e2": ("first", 1, 2, ["a.json", "b.json"], True)}
    reps = C.repetitions(found, "id", "segments", ["id"]).orderBy("repetition").collect()
    assert [(r.id, r.repetition, r.start) for r in reps] == [("e1", 1, 0.0), ("e1", 2, 0.0)] and len({r.repetition_id for r in reps}) == 2
    with pytest.raises(Exception, match="has no id"):
        C.deduplicated(occurrences.withColumn("id", F.nullif("id", F.lit("e2"))), "id", "content", "source", ["source", "at"]).collect()


# ---- exports and predictions


def test_records_round_trip(spark):
    """Nested records with the last of repeated evidence, to flat text and back."""
    from tempora.operators import export as X

    segments = spark.createDataFrame([("s1", 1, True), ("s2", None, False), ("a;b", 3, None)], "id string, n int, pain boolean")
    timing = spark.createDataFrame([("s1", 1, 0.5, ["x"], {"a": 1.5}), ("s1", 2, 0.75, ["a;b", "c\\d", None, "", "\\0"], {"b;": None}), ("zz", 1, 1.0, [], None), ("a;b", 1, None, [], {})], "id string, at int, start double, issues array<string>, metrics map<string,double>")
    deep = spark.createDataFrame([("s1", 1, (4, ("x", [1, None, 3])))], "id string, at int, score struct<total:int,by:struct<name:string,parts:array<int>>>")
    records = X.with_evidence(segments, {"timing": (timing, ["at"]), "deep": (deep, ["at"])}, "id")
    flat = X.flattened(records)
    assert flat.columns == ["id", "n", "pain", "timing__start", "timing__issues", "timing__metrics", "deep__score__total", "deep__score__by__name", "deep__score__by__parts"] and set(dict(flat.dtypes).values()) == {"string"}
    first = flat.where("id = 's1'").first()
    assert (first.pain, first.timing__start, first.timing__issues, first.deep__score__by__parts) == ("true", "0.75", r"a\;b;c\\d;\0;;\\0", r"1;\0;3")
    assert X.nested(flat, records.schema).orderBy("id").collect() == records.orderBy("id").collect()
    assert X.flattened(records, ["deep__score__total", "gone"]).where("gone IS NULL").count() == 3


def test_leaks_are_refused(spark, tmp_path):
    from tempora.operators import predictions as P

    spark.createDataFrame([(1, 2, 5), (2, 3, 6)], "id int, human_score int, seen int").write.parquet(f"{tmp_path}/labels")
    spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id int, x int").write.parquet(f"{tmp_path}/features")
    labels, features = spark.read.parquet(f"{tmp_path}/labels"), spark.read.parquet(f"{tmp_path}/features")
    score = lambda rows: rows.select("id", (F.col("x") / 10).cast("int").alias("suggested"))
    got = {(r.id, r.suggested, r.human_score) for r in P.prediction_package([features], score, labels, "id", "human_score").collect()}
    assert got == {(1, 1, 2), (2, 2, 3), (3, 3, None)}
    made = features.join(labels.select("id", F.col("seen").alias("innocent")), "id")  # another name, but the labels' file
    for leaking in (made, features.withColumn("reviewer_score", F.lit(1)), features.withColumn("a", F.array(F.struct(F.lit(1).alias("consensus"))))):
        with pytest.raises(P.LeakError):
            P.prediction_package([leaking], score, labels, "id", "human_score")
    with pytest.raises(P.LeakError):
        P.prediction_package([features], lambda rows: score(rows).join(labels.select("id", "seen"), "id"), labels, "id", "human_score")
    with pytest.raises(Exception, match="missing or repeats"):
        P.prediction_package([features, features], score, labels, "id", "human_score").collect()
    P.refuse_leaks(features.withColumnRenamed("x", "label_free"), allowed=["label_free"])
