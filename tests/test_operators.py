"""Operators and functions on small tables, with nulls, ties, repeats and empty inputs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from srcquarry.functions import text
from srcquarry.operators import aggregates, graph, greedy, joins, similar, windows
from srcquarry.plans import resolve
from srcquarry.sources import scratch
from srcquarry.streaming import evidence


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], kinds).select(column).first()[0]


def test_text(spark):
    assert one(spark, text.matches_path(F.col("p"), "build/**"), p="build/x/y.py") and not one(spark, text.matches_path(F.col("p"), "build/**"), p="src/build.py")
    assert one(spark, text.matches_path(F.col("p"), "*_pb2.py"), p="a/b_pb2.py")
    assert one(spark, text.package_name(F.col("p")), p=" Foo__Bar.baz! ") == "foo-bar-baz"
    assert one(spark, text.requirement_name(F.col("p")), p="Django[argon2]>=4 ; python_version > '3'") == "django"
    assert one(spark, text.requirement_name(F.col("p")), p="-r other.txt") is None
    assert one(spark, text.absolute_name(F.col("n"), F.col("p")), n="..b.c", p="x.y.z") == "x.y.b.c"
    assert one(spark, text.absolute_name(F.col("n"), F.col("p")), n="....b", p="x.y.z") is None
    assert one(spark, text.prefixes(F.col("p")), p="a.b.c") == ["a.b.c", "a.b", "a"]
    assert one(spark, text.first_filled(F.col("a"), F.lit("z")), a="") == "z"
    name, alias = text.import_spec(F.col("p"))
    assert (one(spark, name, p="a as b as c"), one(spark, alias, p="a as b as c")) == ("a as b", "c")
    assert one(spark, text.words(F.col("p")), p="  ") == []


def test_joins(spark):
    left = spark.createDataFrame([("a.b.c",), ("a.x",), ("q",), (None,)], "name string")
    known = spark.createDataFrame([("a",), ("a.b",)], "target string")
    got = {r.name: r.target for r in joins.first_candidate(left, "name", text.prefixes(F.col("name")), known, "target").collect()}
    assert got == {"a.b.c": "a.b", "a.x": "a"}
    r = random.Random(1)
    rows = [(i % 3, i, (s := r.randint(0, 300)), s + r.randint(0, 60)) for i in range(120)]
    t = spark.createDataFrame(rows, "k int, i int, s int, e int")
    got = {(x.a.i, x.b.i) for x in joins.overlapping(t, t, ["k"], "s", "e", 25).collect()}
    assert got == {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] <= b[3] and b[2] <= a[3]}
    first, rest = joins.first_rows(spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, p string"), ["k"], "p")
    assert {tuple(x) for x in first.collect()} == {(1, "a"), (2, "c")} and [tuple(x) for x in rest.collect()] == [(1, "b", "a")]
    empty = t.limit(0)
    assert joins.overlapping(empty, t, ["k"], "s", "e", 25).count() == 0 and joins.missing(empty, t, "k").count() == 0


def test_graph(spark):
    r = random.Random(2)
    pairs = {(r.randint(0, 14), r.randint(0, 14)) for _ in range(22)}
    e = spark.createDataFrame(sorted(pairs), "src int, dst int")
    reach = {a: {a} for p in pairs for a in p}
    for _ in range(20):
        for a, b in pairs:
            for k in reach:
                if a in reach[k]:
                    reach[k].add(b)
    want = {k: min(j for j in reach if j in reach[k] and k in reach[j]) for k in reach}
    assert {x.node: x.scc_id for x in graph.strong_components(e).collect()} == want
    start = min(reach)
    got = graph.reachable(e, spark.createDataFrame([(start,)], "node int")).collect()
    assert {x.node for x in got} == reach[start]
    far = max(got, key=lambda x: (x.hops, x.node))
    path = graph.shortest_path(e, start, far.node)
    assert len(path) == far.hops + 1 and all(p in pairs for p in zip(path, path[1:]))
    assert graph.shortest_path(e, start, 99) == []


def test_windows(spark):
    rows = [(1, 0, 1), (1, 5, 2), (1, 10, 3), (2, 3, 4), (1, 10, 5), (1, 21, 6), (None, 1, 7)]
    t = spark.createDataFrame(rows, "k int, s int, i int")
    assert {x.i for x in windows.greedy_apart(t, "k", "s", 10, "i").collect()} == {1, 3, 6, 4, 7}
    d = spark.createDataFrame([(1, "a b c d e f"), (2, "x a b c d"), (3, None), (4, "")], "id int, t string")
    got = windows.duplicate_windows(d, "id", "t", 4, 1).collect()
    assert [(x.n, x.n_docs, x.first_doc) for x in got] == [(2, 2, 1)]


def test_aggregates(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c")], "src string, dst string")
    assert {tuple(r) for r in aggregates.degrees(e).collect()} == {("a", 0, 1), ("b", 1, 1), ("c", 1, 0)}
    assert {tuple(r) for r in aggregates.degrees(e, distinct=False).collect()} == {("a", 0, 2), ("b", 2, 1), ("c", 1, 0)}
    assert {r.bucket: r.n for r in aggregates.in_buckets(e, F.col("src"), ("a", "z")).collect()} == {"a": 2, "z": 0}


def test_stream(spark, sf, tmp_path):
    s = evidence.event_counts(spark, f"{sf}/events.parquet*").writeStream.format("memory").queryName("event_counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    s.awaitTermination()
    total = spark.table("event_counts").agg(F.sum("n")).first()[0]
    assert total == spark.read.parquet(f"{sf}/events.parquet").count()
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join('{"repo":"r","fingerprint":"%s","rule":"x","severity":"info","seen":"2026-01-01T00:00:0%dZ"}' % (f, n) for n, f in enumerate("aab")) + "\nbroken")
    found = evidence.first_seen(evidence.read_reports(spark, str(tmp_path / "in")))
    q = found.writeStream.format("memory").queryName("seen_once").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "d")).start()
    q.awaitTermination()
    assert sorted(r.fingerprint for r in spark.table("seen_once").collect()) == ["a", "b"]


def test_round_trips(spark):
    edges = [("x", *e) for e in ("ab", "ac", "bc", "ca")] + [("y", *e) for e in ("ab", "bc", "cb", "bd", "da")] + [("z", *e) for e in ("ab", "bd", "dc", "cd", "cb", "ba", "bc")]
    edges += [("w", *e) for e in ("ab", "bc", "cb", "be", "ea")]
    got = {r.scc_id: "".join(r.path) for r in graph.round_trips(spark.createDataFrame(edges, "scc_id string, src string, dst string")).collect()}
    assert got == {"x": "abca", "y": "abcba", "z": "aba", "w": "abcba"}


def test_first_fit_equals_the_sorted_pass(spark):
    r = random.Random(11)
    rows, want = [], set()
    for repo in range(6):
        groups = [(r.randint(0, 5), f"d{i}", {r.randint(0, 60) for _ in range(r.randint(1, 5))}) for i in range(40)]
        taken: set[int] = set()
        for size, name, places in sorted(groups, key=lambda g: g[:2]):
            rows += [(repo, name, p, (size, name)) for p in places]
            if not places & taken:
                taken |= places
                want.add((repo, name))
    claims = spark.createDataFrame(rows, "repo int, name string, place int, o struct<size: int, name: string>")
    got = greedy.first_fit(claims.unionByName(claims), ["repo", "name"], ["repo", "place"], "o").collect()
    assert {(g.repo, g.name) for g in got} == want and len(got) == len(want)
    assert greedy.first_fit(claims.limit(0), ["repo", "name"], ["repo", "place"], "o").collect() == []


def test_reachable_views(spark):
    r = random.Random(12)
    edges = [(r.randint(0, 40), r.randint(0, 40), r.randint(0, 3)) for _ in range(90)]
    starts = [(0, 3), (1, 1), (2, 2), (99, 2)]
    want = {}
    for bit in (1, 2):
        stack = [n for n, v in starts if v & bit]
        seen = set()
        while stack:
            n = stack.pop()
            if n not in seen:
                seen.add(n)
                want[n] = want.get(n, 0) | bit
                stack += [b for a, b, v in edges if a == n and v & bit]
    got = graph.reachable_views(spark.createDataFrame(edges, "src int, dst int, views int"), spark.createDataFrame(starts, "node int, views int"))
    assert {r.node: r.views for r in got.collect()} == want


def test_counts_through_exports(spark):
    """Equal to a pass over the packages in order, with rings, diamonds and records that stand twice."""
    r = random.Random(13)
    names = [f"p{i}" for i in range(9)]
    records = [(r.choice(names), r.choice("xy"), r.choice(names), r.choice("xy")) for _ in range(40)]
    records = [x for x in records if x[0] != x[2]]
    counts = {(m, n): [r.randint(0, 3), r.randint(0, 2), r.randint(0, 1)] for m in names for n in "xy" if r.random() < 0.7}
    start = [("repo", *k, *v) for k, v in counts.items()]
    for package in sorted(names):
        for m, n, to, symbol in records:
            if m == package and (m, n) in counts:
                there = counts.setdefault((to, symbol), [0, 0, 0])
                for i, c in enumerate(counts[m, n]):
                    there[i] += c
    given = spark.createDataFrame(start, "repo string, module string, name string, production long, tests long, type_only long")
    exported = spark.createDataFrame([("repo", *x) for x in records], "repo string, module string, name string, origin_module string, origin_symbol string")
    got = resolve.through_exports(given, exported).collect()
    assert {(g.module, g.name): [g.production, g.tests, g.type_only] for g in got} == counts


def test_writes_at_once_leave_the_setting(spark):
    from concurrent.futures import ThreadPoolExecutor

    before = spark.conf.get(scratch.CLEANUP, "false")
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda n: scratch.stored(spark.range(n), "many").count(), range(1, 13)))
    assert spark.conf.get(scratch.CLEANUP, "false") == before


def test_similar_equals_comparing_all(spark):
    import difflib

    r = random.Random(14)
    stems = ["get", "user", "name", "load", "path", "core", "http", "x", "__", "é"]
    name = lambda: "".join(r.choice(stems) for _ in range(r.randint(1, 5)))
    known = [(r.choice("ab"), name()) for _ in range(300)]
    asked = [(r.choice("abc"), name()[r.randint(0, 1) :], r.choice([0.45, 0.6, 0.8])) for _ in range(150)] + [("a", None, 0.6), ("a", "", 0.6)]
    got = similar.similar(spark.createDataFrame(asked, "repo string, name string, cutoff double"), spark.createDataFrame(known, "repo string, name string"), ["repo"]).collect()
    want = {(k, n, c): difflib.get_close_matches(n, sorted({x for q, x in known if q == k}), 3, c) for k, n, c in asked if n}
    assert {(g.repo, g.name, g.cutoff): g.close for g in got} == want and len(got) == len(want)


def test_reports_of_many_runs(spark, tmp_path):
    import json

    from srcquarry.plans import evidence as together

    plan = {"blocking": [{"rule": "r1", "severity": "error", "fingerprint": "f1", "file": "a.py", "one_liner": "say"}, 3], "review_needed": [], "issues": [{"rule": "no"}]}
    plain = {"issues": [{"code": "r2", "severity": "Warning", "confidence": "HIGH", "path": "b.py"}, {"severity": "info"}, {"rule": "r1"}, "x", None]}
    (tmp_path / "deep").mkdir()
    for name, text in (("p.json", json.dumps(plan)), ("deep/q.json", json.dumps(plain)), ("deep/bad.json", "{"), ("list.json", "[1]"), ("empty.json", "{}"), ("other.txt", json.dumps(plan))):
        (tmp_path / name).write_text(text)
    found, unread = together.findings_of(together.report_files(spark, str(tmp_path), repo="o/n"))
    got = sorted((r.report.rpartition("/")[2], r.bucket, r.rule, r.severity, r.confidence, r.file, r.message) for r in found.collect())
    assert got == [
        ("p.json", "blocking", "r1", "error", "unknown", "a.py", "say"),
        ("q.json", "auto_safe", "unknown", "info", "unknown", "", ""),
        ("q.json", "blocking", "r2", "Warning", "HIGH", "b.py", ""),
        ("q.json", "review_needed", "r1", "unknown", "unknown", "", ""),
    ]
    assert sorted(r.report.rpartition("/")[2] for r in unread.collect()) == ["bad.json", "list.json"]
    assert {(r.what, r.value): r.n for r in together.counters(found).collect()}[("rule", "r1")] == 2
    text = together.summary_markdown(found, unread)
    assert "- `r1`: 2" in text and "- o/n: skipped" in text and "- Findings observed: 4" in text
    many = found.crossJoin(spark.range(30)).drop("id")
    lines = list(together.comment(many))
    assert "### blocking (60)" in lines and "- ... 40 more" in lines and list(together.comment(found.limit(0)))[-1] == "Nothing was found."


def test_lifecycles_of_a_replayed_stream(spark, tmp_path):
    """The last state of each key is what the batch says, however the runs are dealt over batches."""
    import json

    from srcquarry.plans import evidence as together

    r = random.Random(16)
    rows = [{"repo": r.choice("ab"), "fingerprint": r.choice(["f1", "f2", "f3", "f4", None]), "seen": f"2024-01-{day:02} {r.randint(10, 20)}:00:00"} for day in range(1, 13) for _ in range(6)]
    rows += [{"repo": "a", "fingerprint": "early", "seen": "2024-01-01 09:00:00"}, {"repo": "z", "fingerprint": "last", "seen": "2024-01-30 00:00:00"}, {"repo": "z", "fingerprint": "last", "seen": "2024-01-30 01:00:00"}]
    source = tmp_path / "in"
    source.mkdir()
    kind = "repo string, fingerprint string, seen timestamp"
    q = evidence.lifecycles(spark.readStream.schema(kind).json(str(source)), 5 * 86_400_000).writeStream.outputMode("update").format("memory").queryName("lifecycles").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for n, k in enumerate(range(0, len(rows), 15)):
            (source / f"{n:03}.json").write_text("\n".join(map(json.dumps, sorted(rows, key=lambda x: x["seen"])[k : k + 15])))
            q.processAllAvailable()
        got = {}
        for row in spark.table("lifecycles").collect():
            key = (row.repo, row.fingerprint)
            if key not in got or (row.last_seen, row.status == "resolved") >= (got[key].last_seen, got[key].status == "resolved"):
                got[key] = row
    finally:
        q.stop()
    want = together.states(spark.read.schema(kind).json(str(source)), "5 days").collect()
    assert {k: (v.last_seen, v.status) for k, v in got.items()} == {(w.repo, w.fingerprint): (w.last_seen, w.status) for w in want}
    whole = {(w.repo, w.fingerprint): (w.first_seen, w.runs) for w in want}
    assert all(whole[k] == (v.first_seen, v.runs) for k, v in got.items())


def test_writes_broadcast_by_rows_not_by_files(spark):
    """Files of many like rows are small; their rows, which the driver would hold, are not."""
    planned, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = [spark.conf.get(planned), spark.conf.get(measured, None)]
    spark.conf.set(planned, "1m")
    try:
        asked, many = (scratch.stored(spark.range(n).selectExpr("id", f"repeat('{c}', 60) AS {c}"), "many") for n, c in ((90_000, "a"), (100_000, "b")))
        assert scratch.stored(asked.join(many, "id"), "joined").count() == 90_000
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        done = spark._jsparkSession.sharedState().statusStore().executionsList()
        plan = next(p for k in range(done.size() - 1, -1, -1) if "Join" in (p := done.apply(k).physicalPlanDescription()))
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        assert [spark.conf.get(planned), spark.conf.get(measured, None)] == ["1m", before[1]]
    finally:
        spark.conf.set(planned, before[0])


def test_duplicates_equal_the_sorted_pass(spark, monkeypatch):
    """Files of shared stretches and copies, also in other repositories, by a plain pass; a long copied stretch takes no more steps."""
    import hashlib

    from srcquarry import api
    from srcquarry.sources.declarations import Project
    from srcquarry.sources.python_source import tokens_of

    r = random.Random(17)
    stretch = lambda n: "".join(r.choice([f"a{k} = b + {k}\n", f"c{k} = (\n    d\n)\n", f"e(f, {k})\n"]) for k in range(n))
    pieces = [stretch(n) for n in (6, 9, 12, 20, 90)]
    files = [(repo, f"f{n}.py", "".join(r.choice([r.choice(pieces), stretch(r.randint(1, 6))]) for _ in range(3))) for repo in "ab" for n in range(8)]
    files += [("a", f"copy{n}.py", files[n % 3][2]) for n in range(5)] + [("b", "g_pb2.py", pieces[4]), ("b", "tests/t.py", pieces[4]), ("b", "bad.py", pieces[4] + "(")]
    p = Project(roots=("",), min_tokens=10, min_lines=3, strict_duplicates=True, max_groups=7)
    want = []
    for repo in "ab":
        groups: dict[str, list] = {}
        for _, path, text in (f for f in files if f[0] == repo and f[1] not in ("g_pb2.py", "tests/t.py", "bad.py")):
            toks, kept = tokens_of(text, True), {}
            for at in range(0, len(toks) - 9, 5):
                first, last, digest = toks[at]["first"], toks[at + 9]["last"], hashlib.sha1(" ".join(t["tok"] for t in toks[at : at + 10]).encode()).hexdigest()[:20]
                if last - first >= 2 and first > kept.get(digest, 0):
                    kept[digest] = last
                    groups.setdefault(digest, []).append((path, first, last))
        sets, lines, taken = set(), set(), []
        for _, digest, parts in sorted(((v[0][1] - v[0][2], v[0][0], v[0][1], d), d, v) for d, v in ((d, sorted(v)) for d, v in groups.items())):
            paths, own = frozenset(x for x, *_ in parts), {(x, n) for x, a, b in parts for n in range(a, b + 1)}
            if len(paths) > 1 and paths not in sets and not own & lines:
                sets.add(paths)
                lines |= own
                taken.append((repo, digest, parts))
        want += taken[:7]
    assert len(want) > 7
    rows = spark.createDataFrame(files, "repo string, path string, text string")
    for few in (greedy.FEW, 0):
        monkeypatch.setattr(greedy.first_fit, "__defaults__", (None, few))
        with scratch.noted_tables() as made:
            got = api.repositories(rows, p).duplicates.collect()
        assert sorted((g.repo, g.digest, [tuple(f) for f in g.fragments]) for g in got) == sorted(want)
        assert not few or len(made) < 16


def test_one_pass_sees_all_claims_of_its_value(spark):
    """However joins are planned when they run, the claims of a value of ``apart`` come to one task."""
    r = random.Random(18)
    rows, want = [], set()
    for repo in range(5):
        taken: set[int] = set()
        for n, places in enumerate({r.randint(0, 900) for _ in range(4)} for _ in range(400)):
            rows += [(f"r{repo}", n, p) for p in places]
            if not places & taken:
                taken |= places
                want.add((f"r{repo}", n))
    settings = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        claims = spark.createDataFrame(rows, "repo string, n int, place int").repartition(40).withColumn("o", F.col("n"))
        got = greedy.first_fit(claims, ["repo", "n"], ["repo", "place"], "o", "repo").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(g.repo, g.n) for g in got} == want and len(got) == len(want)
