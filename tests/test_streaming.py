"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from loomline.operators import activity as act
from loomline.streaming import live
from loomline.streaming.tail import TailReader, TailSource

SCHEMA = "seq long, ts timestamp_ntz, session string, type string, status string, tool_call long, value double"
KINDS = ["prompt.submitted", "tool.started", "tool.completed", "turn.completed", "error"]


def events(spark, n=400):
    k = F.col("id")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.abs(F.xxhash64(k)) % 5 + 1).cast("int"))
    return spark.range(n).select(
        k.alias("seq"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), k)).alias("ts"),
        F.concat(F.lit("s"), k % 7).alias("session"),
        kind.alias("type"),
        F.when(kind == "error", "failed").otherwise("ok").alias("status"),
        (k % 11).alias("tool_call"),
        F.lit(1.0).alias("value"),
    )


def stream_of(spark, tmp_path, df, parts=4):
    folder = str(tmp_path / "in")
    for i in range(parts):
        df.where(f"seq % {parts} = {i}" if parts == 1 else f"seq >= {i * 100} and seq < {(i + 1) * 100}").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_sessions(spark, tmp_path):
    df = events(spark)
    out = drain(live.sessions(stream_of(spark, tmp_path, df)), "sessions", "update")
    last = out.groupBy("session").agg(F.max_by(F.struct("events", "failures", "last_type", "turn_open"), "events").alias("r")).select("session", "r.*")
    want = act.session_states(df, F.lit("2024-01-02").cast("timestamp_ntz")).select("session", "events", "failures", "last_type", "turn_open")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


def test_tool_spans(spark, tmp_path):
    df = events(spark)
    out = drain(live.tool_spans(stream_of(spark, tmp_path, df)), "spans", "append")
    want = act.tool_spans(df).fillna(-1, ["start_seq", "duration_ms"]).drop("outcome")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_session_lifecycle(spark, tmp_path):
    from loomline.operators import sessions

    kinds = ["session.started", "user.message", "tool.started", "permission.requested", "permission.completed", "tool.completed", "tool.failed", "error", "session.ended", "agent.completed", "odd"]
    k = F.col("seq")
    pick = lambda salt, n: (F.abs(F.xxhash64(k, F.lit(salt))) % n).cast("int")
    df = events(spark).withColumns({"type": F.element_at(F.array(*map(F.lit, kinds)), pick(1, len(kinds)) + 1), "session": F.concat(F.lit("s"), pick(2, 40)), "tool_call": F.when(pick(3, 5) > 0, pick(4, 3).cast("bigint"))})
    df = df.withColumns({"result": F.when(F.col("type") == "permission.completed", F.element_at(F.array(F.lit("denied-by-user"), F.lit("approved")), pick(5, 2) + 1)), "agent": F.when(pick(6, 2) == 0, F.col("session")).otherwise("a"), "status": F.when(F.col("type") == "error", "failed")})
    out = drain(live.session_lifecycle(stream_of(spark, tmp_path, df)), "lifecycle", "update")
    last = out.groupBy("session").agg(F.max_by(F.struct(*out.columns[1:]), "events").alias("r")).select("session", "r.*")
    at = lambda c: act.millis(c).alias(c)
    for late in ("2024-01-01 06:39:30", "2024-01-01 06:42:00", "2024-01-01 07:30:00"):
        now = F.lit(late).cast("timestamp_ntz")
        got = live.status_at(last, act.millis(now)).select("session", "events", "started", "last_at", "failures", "last_type", "turn_open", "status", "waiting_call", "waiting_since", "ended_at", "denied_at", "last_outcome")
        want = sessions.states(df, now).select("session", "events", at("started"), at("last_at"), "failures", "last_type", "turn_open", "status", "waiting_call", at("waiting_since"), at("ended_at"), at("denied_at"), "last_outcome")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r.status for r in got.select("status").distinct().collect()} >= {"waiting", "stalled"}


def test_dedupe_in_a_ring(spark, tmp_path):
    ring, seen, want = 5, {}, []
    df = events(spark).withColumns({"session": F.concat(F.lit("s"), F.col("seq") % 2), "tool_call": F.when(F.col("seq") % 17 > 0, F.abs(F.xxhash64("seq")) % 9)})
    for r in df.orderBy("seq").collect():
        own = seen.setdefault(r.session, [])
        if r.tool_call is None or r.tool_call not in own:
            want.append(r.seq)
            if r.tool_call is not None:
                own.append(r.tool_call)
                del own[: max(0, len(own) - ring)]
    got = drain(live.dedupe_in_ring(stream_of(spark, tmp_path, df), "session", "tool_call", ring), "ring", "append")
    assert got.columns == df.columns and sorted(r.seq for r in got.collect()) == want and 50 < len(want) < 400


def test_dedupe_and_counts(spark, tmp_path):
    df = events(spark).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = stream_of(spark, tmp_path, df)
    got = drain(live.dedupe(stream, "session", "type", within="1 day"), "dedupe", "append")
    assert got.count() == df.select("session", "type").distinct().count()
    n = drain(live.counts(stream, "1 minute"), "counts", "complete").agg(F.sum("n")).first()[0]
    assert n == 400


def test_archive_stream_is_idempotent(spark, tmp_path):
    df = events(spark)
    path = str(tmp_path / "archive")
    q = live.archive_stream(stream_of(spark, tmp_path, df), path, str(tmp_path / "cp"))
    q.awaitTermination(120)
    back = spark.read.json(path)
    assert back.count() == 400 and back.select("seq").distinct().count() == 400


def test_tail_ranges_share_out_lines(tmp_path):
    text = "one\n\ntwo\na longer line\nlast\nhalf"
    (tmp_path / "a.jsonl").write_text(text)
    for size in (1, 2, 3, 5, 8, 100):
        reader = TailReader(str(tmp_path), False, ".jsonl", size)
        parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
        got = [(offset, line) for p in parts for _, offset, line in reader.read(p)]
        assert [line for _, line in got] == ["one", "", "two", "a longer line", "last"], size
        assert all(text[o:].startswith(line) for o, line in got)
    assert TailReader(str(tmp_path), True, ".jsonl", 5).initialOffset() == reader.latestOffset()


def test_tail_follows_appends(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    (folder / "a.jsonl").write_text("one\ntwo\nhalf")
    spark.dataSource.register(TailSource)
    stream = spark.readStream.format("tail").option("path", str(folder)).option("rangebytes", 100_000).load()
    q = stream.writeStream.format("memory").queryName("tail").start()
    q.processAllAvailable()
    assert [r.line for r in spark.table("tail").orderBy("offset").collect()] == ["one", "two"]
    with open(folder / "a.jsonl", "a") as f:
        f.write(" done\n")
    (folder / "b.jsonl").write_text("new\n" + "x" * 300_000 + "\n")
    for i in range(70):
        (folder / f"c{i}.jsonl").write_text(f"c{i}\n")
    q.processAllAvailable()
    (folder / "a.jsonl").write_text("cut\n")
    q.processAllAvailable()
    q.stop()
    # no file and no line is too many or too long
    assert sorted(r.line for r in spark.table("tail").collect()) == sorted(["one", "two", "half done", "new", "x" * 300_000, "cut", *(f"c{i}" for i in range(70))])


def test_rejects_and_frames(spark):
    df = events(spark, 20).withColumn("session", F.when(F.col("seq") > 2, F.col("session")))
    ok, bad = live.reject_stream(df)
    assert ok.count() == 17 and {r.code for r in bad.collect()} == {"MISSING_SESSION"}
    assert live.frames(ok.orderBy("seq")).first().frame.startswith("id: 3\nevent: activity\ndata: {")
