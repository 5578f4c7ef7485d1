"""What keeps tasks small on large tables: plans without the steps that grew too fast, with results by brute force."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from loomline.operators import activity, history, metrics, resolver, selection, sessions, views
from loomline.plans import catalog
from loomline.sources import archive, python_code
from loomline.sources import relational as src

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rays_find_agents_by_equal_keys(spark):
    agents = spark.createDataFrame([("agent:1", "g1", "s", "w", True), ("agent:2", "g1", "s", "w", True), (None, "g2", "s", "w", True)], "id string, agent string, session string, workspace string, visible boolean")
    rays = [(1, "agent:1", "g1", None), (2, "agent:1", "g1", "x"), (3, "agent:1", "agent:2", None), (4, "agent:1", "agent:2", "x"), (5, "agent:1", "nobody", "x"), (6, "agent:1", "g2", "x")]
    rays = spark.createDataFrame([(r, "s", a, "w", "agent:2", "w", link, session, None) for r, a, link, session in rays], "ray int, session string, source string, workspace string, target string, target_workspace string, link string, link_session string, link_workspace string")
    out = views.compatible_rays(rays, agents)
    assert {r.ray for r in out.collect()} == {1, 3, 5}
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)


def test_files_of_one_partition_are_parsed_by_many_tasks(spark):
    files = spark.range(40).select(F.concat(F.lit("m"), "id", F.lit(".py")).alias("path"), F.lit("def f():\n    g()\n").alias("source")).coalesce(1)
    found = python_code.facts(files)
    assert found.rdd.getNumPartitions() > 1
    assert {r.fact: r["count"] for r in found.groupBy("fact").count().collect()} == {"module": 40, "function": 40, "calls": 40}


def test_prints_parse_each_file_once(spark):
    assert "MapInPandas" not in plan(catalog.QUERIES["python_prints"](spark, SF))


def test_overrides_in_lists(spark):
    nodes = [(f"{ns}{name}{i}", "var", name, ns) for ns in "abc" for name in "xyz" for i in range(7)]
    edges = spark.createDataFrame([("requires", "ax0", "by1"), ("requires", "cx0", "ay1"), ("calls", "bx0", "cy1")], "kind string, source string, target string")
    out = selection.overrides(edges, spark.createDataFrame(nodes, "id string, kind string, label string, namespace string"), each=2)
    want = sorted((c, p, n) for c, _, n, a in nodes for p, _, m, b in nodes if n == m and (a, b) in {("a", "b"), ("c", "a")})
    assert sorted(tuple(r) for r in out.collect()) == want


def test_overrides_are_dealt_by_the_pairs_that_come_out(spark):
    nodes = [(f"{ns}{i}", "var", name, ns) for ns in "ab" for i, name in enumerate(["x"] * 40 + ["y", "z"])]
    edges = spark.createDataFrame([("requires", "a0", "b1"), ("requires", "a2", "b0"), ("mentions", "b0", "a0")], "kind string, source string, target string")
    out = selection.overrides(edges, spark.createDataFrame(nodes, "id string, kind string, label string, namespace string"), task_pairs=100)
    assert out.rdd.getNumPartitions() == 17
    assert sorted(tuple(r) for r in out.collect()) == sorted((c, p, n) for c, _, n, a in nodes for p, _, m, b in nodes if n == m and (a, b) == ("a", "b"))


def _shares_of_paths(ids, arcs):
    """Betweenness by brute force, a walk for each source."""
    ahead, score = {}, dict.fromkeys(ids, 0.0)
    for a, b in arcs:
        ahead.setdefault(a, []).append(b)
    for s in ids:
        paths, depth, before, order = {s: 1}, {s: 0}, {}, [s]
        for v in order:
            for w in ahead.get(v, ()):
                if w not in depth:
                    depth[w], paths[w] = depth[v] + 1, 0
                    order.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
                    before.setdefault(w, []).append(v)
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order[1:]):
            for v in before[w]:
                delta[v] += paths[v] / paths[w] * (1 + delta[w])
            score[w] += delta[w]
    return score


def test_betweenness_takes_every_source(spark):
    rng = random.Random(6)
    left, inner, right = ([f"{c}{i}" for i in range(n)] for c, n in (("l", 140), ("m", 12), ("r", 140)))
    ids = [*left, *inner, *right]
    arcs = {(a, rng.choice(inner)) for a in left for _ in range(2)} | {(rng.choice(inner), b) for b in right for _ in range(2)} | {("m0", "l0"), ("m1", "m2"), ("r3", "r3")}
    want = _shares_of_paths(ids, [(a, b) for a, b in sorted(arcs) if a != b])
    pairs, nodes = spark.createDataFrame(sorted(arcs), "a string, b string"), spark.createDataFrame([(i,) for i in ids], "id string")
    assert {r.id: round(r.score, 6) for r in metrics.betweenness(pairs, nodes).collect()} == {i: round(v, 6) for i, v in want.items()}


def test_betweenness_in_runs_of_sources(spark):
    ids = list("abcdefg")
    arcs = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "a"), ("f", "d")]
    pairs, nodes = spark.createDataFrame(arcs, "a string, b string"), spark.createDataFrame([(i,) for i in ids], "id string")
    assert {r.id: round(r.score, 6) for r in metrics.betweenness(pairs, nodes, at_once=3).collect()} == _shares_of_paths(ids, arcs)
    assert metrics.betweenness(pairs.limit(0), nodes.limit(0)).count() == 0


def test_permissions_look_ahead_in_frames_that_grow(spark):
    rows = [(1, "permission.requested", 1), (2, "permission.requested", 1), (3, "tool.started", 2), (4, "permission.completed", 1), (5, "permission.requested", 2)]
    events = spark.createDataFrame([(s, "s", t, c) for s, t, c in rows], "seq long, session string, type string, tool_call long").withColumns(
        {"ts": F.timestamp_seconds("seq"), "status": F.lit("ok"), "agent": F.lit(None).cast("string"), "result": F.lit(None).cast("string")}
    )
    out = sessions.permissions(events)
    assert {(r.asked_seq, r.answered_seq, r.waited_ms) for r in out.collect()} == {(1, None, None), (2, 4, 2000), (5, None, None)}
    assert "unboundedfollowing" not in plan(out)


def test_changes_are_dealt_by_the_number_of_lines(spark):
    assert src.changes(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def _history(spark):
    rng = random.Random(5)
    seen = {(c, f"n{rng.randrange(6)}") for c in range(60) for _ in range(3)}
    order = spark.createDataFrame([(c, c) for c in range(60)], "commit long, i long")
    return seen, spark.createDataFrame(sorted(seen), "commit long, ns string"), order


def test_lagged_coupling_by_sets(spark):
    seen, rows, order = _history(spark)
    want = {}
    for a, b, i in {(x, y, i) for i, x in seen for j, y in seen if i < j <= i + 3 and x != y}:
        want[a, b] = want.get((a, b), 0) + 1
    out = history.lagged_coupling(rows, order, lag=3)
    assert {(r.a, r.b): r.follows for r in out.collect()} == want
    assert plan(out).count("Generate") >= 3


def test_rolling_edits_over_blocks(spark):
    seen, rows, order = _history(spark)
    for last in (1, 4, 7):
        want = {n: max(sum((j, n) in seen for j in range(i - last + 1, i + 1)) for i in range(60)) for _, n in seen}
        assert {r.ns: r.most for r in history.rolling_edits(rows, order, last, block=7).collect()} == want


def test_places_are_looked_up_once(spark):
    resources = [(e, 1, None, None, None, "a.py", 5, "read", True, False) for e in range(50)]
    resources = spark.createDataFrame(resources, "event long, k int, node_id string, kind string, name string, path string, line int, action string, here boolean, outside boolean")
    nodes = spark.createDataFrame([(f"n{i}", "var", "a", "a.py", i, 9) for i in range(6)], "id string, kind string, namespace string, file string, row int, end_row int")
    out = resolver.resolve(resources, nodes, "/repo")
    assert {(r.event, r.id, r.how) for r in out.collect()} == {(e, "n5", "span") for e in range(50)}
    assert any("keys=[file#" in x and ", line#" in x for x in plan(out).splitlines())


def test_heavy_rows_are_dealt_by_number(spark):
    for name in ("argument_resources", "shell_intents"):
        assert catalog.QUERIES[name](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_playback_edges_are_dealt_for_each_join(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("requires", "a", "c"), ("requires", "c", "a"), ("calls", "c", "b"), ("calls", "c", "d")], "kind string, source string, target string")
    out = views.playback_edges(edges, ids.withColumn("value", F.lit(1)), ids.limit(0), ids.limit(0), edges.where("source = 'a'"), tasks=6)
    assert {tuple(r) for r in out.collect()} == {("requires", "a", "c"), ("calls", "c", "b")}
    assert plan(out).count("REPARTITION_BY_NUM") >= 4


def test_an_archive_has_no_file_for_each_recording(spark, tmp_path):
    ids = [*(f"r{i % 40}" for i in range(120)), 'say "\\x"', "", None]
    rows = [(r, i, datetime(2024, 1, 1), '{"a":1}') for i, r in enumerate(ids)]
    path = tmp_path / "archive"
    for part in (rows[:60], rows[60:]):
        archive.append(spark.createDataFrame(part, "recording_id string, recordingSequence long, capturedAt timestamp_ntz, event string"), str(path))
    assert len(list(path.rglob("*.json"))) <= 8
    (path / "late.json").write_text('{"recording_id":"r1","recordingSequence":7,"ev\n{"recording_id":"say \\"\\\\x\\"","recordi\n{"recordi\n')
    got = {r.recording_id: (r.event_count, r.last_sequence) for r in archive.manifest(archive.read(spark, str(path))).collect()}
    assert got == {f"r{i}": (3 + (i == 1), 80 + i) for i in range(40)} | {'say "\\x"': (2, 120), "": (1, 121), None: (2, 122)}


def _meets_in_pairs(df):
    return any("Join" in x and "<=" in x for x in plan(df).splitlines())


def test_live_groups_by_running_folds(spark):
    rng = random.Random(3)
    pick = lambda *v: rng.choice([*v, None])
    specs = [(s, rng.choice([rng.randrange(-60, 60), None] + 8 * [7]), pick("a", "b"), pick("p", "q"), f"l{s}", rng.choice("xy"), pick(1, 2), pick("ok", "bad")) for s in rng.sample(range(300), 300)]
    times = [*range(-70, 90, 3), 7, 7, 17, None]
    want = {}
    for at in {t for t in times if t is not None}:
        for g in ("a", "b", None):
            rows = sorted(r for r in specs if r[1] is not None and r[2] == g and 0 <= at - r[1] <= 10)
            if rows:
                last, outcomes = max(r[1] for r in rows), [r[7] for r in rows if r[7]]
                want[at, g] = (rows[-1][3], rows[0][4], rows[-1][5], last, last + 10, sum(r[6] or 0 for r in rows), outcomes[-1] if outcomes else None)
    specs = spark.createDataFrame(specs, "seq long, ms long, id string, parent string, label string, kind string, weight int, outcome string")
    out = activity.live_groups(specs, spark.createDataFrame([(t,) for t in times], "at long"), ttl_ms=10)
    got = [((r.at, r.id), (r.parent, r.label, r.kind, r.last_at, r.expires_at, r.weight, r.outcome)) for r in out.collect()]
    assert len(got) == len(want) and dict(got) == want
    assert not _meets_in_pairs(out)


def test_signatures_look_up_last_updates(spark):
    marks = spark.createDataFrame([("a", 5), ("a", 14), ("b", 14), ("a", 14), (None, 3), ("b", None)], "id string, ms long")
    out = activity.within(marks, spark.createDataFrame([(4,), (15,), (24,), (25,), (99,)], "at long"), 10)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(4, None, 3), (15, "a", 14), (15, "b", 14), (24, "a", 14), (24, "b", 14)], key=repr)
    assert not _meets_in_pairs(catalog.QUERIES["changed_signatures"](spark, SF))


def test_rounds_go_by_the_longest_way_not_by_the_renames(spark, monkeypatch):
    rng, rounds = random.Random(4), []
    monkeypatch.setattr(history, "keep", lambda df, label="step", keep=history.keep: rounds.append(label) or keep(df, label))
    for groups in (20, 600):  # circles of 1 to 7 paths with two ways of 1 to 3 renames into each, and chains of 5
        hops = {}
        for g in range(groups):
            n = g % 7 + 1
            hops |= {f"c{g}.{i}": f"c{g}.{(i + 1) % n}" for i in range(n)} | {f"e{g}.{i}": f"e{g}.{i + 1}" for i in range(5)}
            for w in "uv":
                way = [f"{w}{g}.{i}" for i in range(rng.randrange(3) + 1)]
                hops |= dict(zip(way, [*way[1:], f"c{g}.{rng.randrange(n)}"], strict=True))
        want = {}
        for path in {*hops, *hops.values()}:
            way = [path]
            while way[-1] in hops and hops[way[-1]] not in way:
                way.append(hops[way[-1]])
            want[path] = hops.get(way[-1], way[-1])
        got = history.resolve_renames(spark.createDataFrame([(p,) for p in want], "path string"), spark.createDataFrame(list(hops.items()), "old string, new string")).collect()
        assert {r.path: r.now for r in got} == want and len(got) == len(want)
        rounds.append("|")
    small, large = "".join(x[0] for x in rounds).split("|")[:2]
    assert small == large
