import datetime as dt
import random

from plain_fold import play

from tessera.operators.report import idle_gaps
from tessera.streaming import jobs

MOVES = "board_id long, id long, x long, y long, uid long"


def write_files(spark, path, batches, schema):
    """One file per batch, in an order the file source keeps."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/b{i:03d}")


def source(spark, path, schema):
    frame = spark.createDataFrame([], schema)
    return (
        spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    )


def random_log(seed, boards, n, size=5):
    rng = random.Random(seed)
    return {
        b: [(i + 1, rng.randrange(size), rng.randrange(size), rng.randrange(2)) for i in range(n)]
        for b in range(boards)
    }


def test_replay_stream_equals_the_rules(spark, tmp_path):
    logs = random_log(9, 6, 90)
    batches = [[(b, *m) for b, ms in logs.items() for m in ms[k : k + 30]] for k in (0, 30, 60)]
    late = (0, 5, 99, 99, 1)
    batches[2].append(late)
    for rows in batches:
        random.Random(1).shuffle(rows)
    write_files(spark, tmp_path / "in", batches, MOVES)
    root = str(tmp_path / "out")
    stream = source(spark, tmp_path / "in", MOVES)
    jobs.start_replay(stream, root, str(tmp_path / "checkpoint")).awaitTermination()
    want_state, want_log = {}, {}
    for b, moves in logs.items():
        state, entries = play(moves)
        want_state |= {(b, *c): s for c, s in state.items()}
        want_log |= {(b, i): e for i, e in entries.items()}

    def check():
        now = jobs.current_stones(spark, root).collect()
        assert {(r.board_id, r.x, r.y): (r.id, r.uid, r.bid) for r in now} == want_state
        log = jobs.replay_log(spark, root).collect()
        rejected = [r for r in log if r.outcome == "late"]
        assert [(r.board_id, r.id, r.x) for r in rejected] == [(0, 5, 99)]
        got = {(r.board_id, r.id): (r.outcome, r.captured, r.merged) for r in log if r.outcome != "late"}
        assert got == want_log and len(log) == len(want_log) + 1

    check()
    assert any(e[1] for e in want_log.values())
    # A micro-batch that runs again after a failure leaves the same tables.
    jobs.replay_batch(spark.createDataFrame(batches[2], MOVES), 2, root)
    check()


def test_ingest_stream_keeps_first_writers(spark, tmp_path):
    rng = random.Random(4)
    bodies, first = [], {}
    for i in range(300):
        x, y, u = rng.randrange(8), rng.randrange(8), rng.randrange(3)
        bad = i % 13 == 0
        bodies.append((1, i, '{"x":"a"}' if bad else f'{{"x":{x},"y":{y},"uid":{u}}}'))
        if not bad:
            first.setdefault((x, y), (i, u))
    bodies.append((1, 300, '{"x":20000}'))
    schema = "board_id long, id long, body string"
    write_files(spark, tmp_path / "in", [bodies[:100], bodies[100:200], bodies[200:]], schema)
    out = str(tmp_path / "out")
    stream = jobs.stream_ingest(source(spark, tmp_path / "in", schema))
    query = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .foreachBatch(lambda df, e: df.write.mode("overwrite").parquet(f"{out}/epoch={e}"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(out).drop("epoch").distinct().collect()
    assert {(r.x, r.y): (r.id, r.uid) for r in rows} == first
    assert len(rows) == len(first)
    refused = (
        jobs.stream_rejects(source(spark, tmp_path / "in", schema))
        .writeStream.option("checkpointLocation", str(tmp_path / "checkpoint2"))
        .trigger(availableNow=True)
        .format("parquet")
        .start(str(tmp_path / "refused"))
    )
    refused.awaitTermination()
    reasons = [r.reason for r in spark.read.parquet(str(tmp_path / "refused")).collect()]
    assert sorted(set(reasons)) == ["not a move", "out_of_range"] and len(reasons) == 25


def test_idle_stream_closes_sessions(spark, tmp_path):
    schema = f"{MOVES}, ts timestamp_ntz"
    start = dt.datetime(2024, 3, 31)

    def at(key, i, s):
        return (key, i, 0, 0, 1, start + dt.timedelta(seconds=s))

    # Gaps of 1199 s (none) and 1200 s; key 2 then moves the clock far ahead.
    early = [at(1, 0, 0), at(1, 1, 1199), at(1, 2, 2399.5), at(2, 3, 100)]
    later = [at(2, 4, 50000), at(1, 5, 40000)]
    too_late = [at(1, 6, 500), at(2, 7, 60000)]
    write_files(spark, tmp_path / "in", [early, later, too_late], schema)
    out = str(tmp_path / "out")
    sessions = jobs.stream_idle(source(spark, tmp_path / "in", schema))
    query = (
        sessions.writeStream.outputMode("append")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .format("parquet")
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    base = int((start - dt.datetime(1970, 1, 1)).total_seconds())
    got = sorted(
        (r.board_id, r.started - base, r.ended - base, r.moves) for r in spark.read.parquet(out).collect()
    )
    assert got == [(1, 0, 1199, 2), (1, 2399, 2399, 1), (1, 40000, 40000, 1), (2, 100, 100, 1), (2, 50000, 50000, 1)]
    on_time = spark.createDataFrame(early + later + too_late[1:], schema)
    gaps = {r.board_id: r.n for r in idle_gaps(on_time).groupBy("board_id").count().selectExpr("board_id", "count as n").collect()}
    assert gaps == {1: 2, 2: 2}
