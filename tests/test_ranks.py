import random

from pyspark.sql import functions as F

from newsprism.operators import ranks


def test_numbered_and_running(spark):
    random.seed(3)
    values = [random.randrange(40) if k % 7 else None for k in range(3000)]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id int, v int").repartition(5)
    order = [F.asc_nulls_last("v"), F.col("id")]
    want = sorted(range(3000), key=lambda k: (values[k] is None, values[k] or 0, k))
    got = {r.id: r.place for r in ranks.numbered(rows, order, "place").collect()}
    assert got == {k: i for i, k in enumerate(want)}
    sums = {r.id: r.s for r in ranks.running(rows, order, F.coalesce("v", F.lit(0)), "s", 7).collect()}
    total = 0
    for k in want:
        assert sums[k] == total
        total += values[k] or 0
    assert ranks.numbered(rows.limit(0), order).count() == 0


def test_first_sorts_with_a_limit(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") * 37 % 1000).alias("v"))
    few = ranks.first(rows, [F.desc("v")], 5)
    assert [(r.v, r.k) for r in few.orderBy("k").collect()] == [(999 - k, k) for k in range(5)]
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_scratch_belongs_to_its_thread(spark):
    import threading

    from newsprism.storage import Scratch, stored

    inside, done, found = threading.Event(), threading.Event(), []

    def other():
        inside.wait(60)
        table = stored(spark.range(5).toDF("x"), "other")
        done.set()
        ended.wait(60)
        found.append(table.count())

    ended = threading.Event()
    thread = threading.Thread(target=other)
    thread.start()
    with Scratch(spark) as scratch:
        stored(spark.range(2).toDF("x"), "step")
        inside.set()
        done.wait(60)
        assert len(scratch.paths) == 1
    ended.set()
    thread.join()
    assert found == [5]


def test_ranked_values(spark):
    random.seed(7)
    data = {"hot": [random.randrange(500) for _ in range(4001)], "few": [3, 1, 2, 2], "one": [9], "gone": []}
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("few", None), (None, 5), ("gone", None)]
    df = spark.createDataFrame(rows, "label string, v int").repartition(6)
    n = F.col("n")
    wanted = [("least", F.lit(0)), ("p10", ranks.nearest_rank(n, 0.1)), ("mid", F.floor((n - 1) / 2)), ("most", n - 1)]
    got = {r.label: (r.n, r.least, r.p10, r.mid, r.most) for r in ranks.ranked_values(df, "label", "v", wanted, 9).collect()}
    want = {k: (len(v), min(v), sorted(v)[round((len(v) - 1) * 0.1)], sorted(v)[(len(v) - 1) // 2], max(v)) for k, v in data.items() if v}
    assert got == want


def test_picks_limit_before_they_gather(spark):
    """No row goes to the single task of a pick but the first ones of each task."""
    from newsprism.operators import selection

    rows = spark.range(10_000).select("id", (F.col("id") * 7919 % 10_007).alias("v"))
    order = [F.desc("v"), F.col("id")]
    for df in (selection.two_lanes(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), order, 20), selection.waves(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), order, 10, 30), selection.newest_and_oldest(rows, order, [F.col("v"), F.col("id")], 12)):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            plan = df._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert "TakeOrderedAndProject" in plan
        for k, line in enumerate(lines := plan.splitlines()):
            if "Exchange SinglePartition" in line and "Reused" not in line:
                below = [x.split("- ", 1)[-1] for x in lines[k + 1 :]]
                assert any("TakeOrderedAndProject" in x or "HashAggregate" in x for x in below), plan
    placed = selection.cohort(rows, order, 5, 7, 3)
    assert "SinglePartition" not in placed._jdf.queryExecution().executedPlan().toString().split("Scan")[0]


def test_intervals_by_bins(spark):
    from datetime import date, timedelta

    from newsprism.operators import graph

    random.seed(1)
    day = lambda: date(2020, 1, 1) + timedelta(days=random.randrange(900))
    dates = list({day() for _ in range(60)})
    spans = [(k, *sorted((day(), day()))) for k in range(80)] + [(100, None, day()), (101, day(), None), (102, None, None), (103, date(2022, 1, 1), date(2021, 1, 1))]
    schema = "k int, valid_from date, valid_to date"
    found = graph.during(spark.createDataFrame([(d,) for d in dates], "at date"), spark.createDataFrame(spans, schema))
    want = {(d, k) for d in dates for k, a, b in spans if (a or d) <= d <= (b or d)}
    got = [(r.at, r.k) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan or "BroadcastHashJoin" in plan or "ShuffledHashJoin" in plan


def test_assignment_equals_the_sequential_one(spark):
    """Random match graphs, ties included, in order of (time, id)."""
    from newsprism.operators import stories

    rng = random.Random(11)
    for n, ties in ((60, False), (60, True), (300, True)):
        when = {k: rng.randrange(8 if ties else 10**6) for k in range(1, n + 1)}
        pairs = {}
        for a in when:
            for b in rng.sample(sorted(when), rng.choice([0, 1, 1, 3])):
                if a != b and (b, a) not in pairs:
                    pairs[a, b] = rng.choice([0.5, 0.6, 0.7]) if ties else rng.random()
        chain = sorted(when, key=lambda x: (when[x], x))
        pairs |= {(x, y): 0.9 for x, y in zip(chain[: n // 2], chain[1 : n // 2], strict=False)}  # a long chain
        both = {p: s for p, s in pairs.items()}
        links = {}
        for (a, b), s in both.items():
            late, early = (a, b) if (when[a], a) > (when[b], b) else (b, a)
            links.setdefault(late, []).append((s, when[early], early))
        story = {}
        for a in chain:
            options = [(-s, -t, str(story[b]), story[b]) for s, t, b in links.get(a, ())]
            story[a] = min(options)[3] if options else a
        scored = spark.createDataFrame([(a, b, when[a], when[b], s) for (a, b), s in both.items()], "a_id long, b_id long, a_time_s long, b_time_s long, similarity double")
        articles = spark.createDataFrame(list(when.items()), "article_id long, time_s long")
        assert {r.article_id: r.story_id for r in stories.assign_in_order(scored, articles).collect()} == story
