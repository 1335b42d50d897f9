"""States: gates, leases, invalidation and normalization on small tables."""

from pyspark.sql import functions as F

from newsprism.operators import states

SCHEMA = "id long, state string, attempts int, worker string, until_s long"
NOW = 1000


def made(spark):
    rows = [(1, "pending", 0, None, None), (2, "claimed", 1, "A", 999), (3, "claimed", 1, "A", 1001), (4, "failed", 2, None, 1000), (5, "failed", 5, None, 10), (6, "failed", 1, None, 2000), (7, "succeeded", 1, None, None), (8, None, 0, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_a_gate_claims_what_is_free(spark):
    got = {r.id: (r.state, r.attempts, r.worker, r.until_s) for r in states.claim(made(spark), "B", NOW).collect()}
    assert got == {1: ("claimed", 1, "B", 1300), 2: ("claimed", 2, "B", 1300), 4: ("claimed", 3, "B", 1300)}


def test_leases_and_new_states(spark):
    df = made(spark)
    got = {r.id: r.o for r in df.select("id", states.leases(df, "A", NOW).alias("o")).collect()}
    assert got[2] == "lease_expired" and got[3] == "held" and got[1] == got[7] == "lease_lost"
    wanted = spark.createDataFrame([(1,), (9,), (9,), (10,)], "id long")
    assert sorted((r.id, r.state, r.attempts) for r in states.ensured(df, wanted, "id").collect()) == [(9, "pending", 0), (10, "pending", 0)]


def test_backoff(spark):
    waits = [r.w for r in spark.createDataFrame([(n,) for n in (0, 1, 2, 6, 7, 1000)], "n int").select(states.backoff(F.col("n")).alias("w")).collect()]
    assert waits == [60, 60, 120, 1920, 3600, 3600]


def test_changes_make_due(spark):
    have = spark.createDataFrame([(1, "h1", "v1"), (2, "h2", "v1"), (3, None, None)], "id long, hash string, version string")
    inputs = spark.createDataFrame([(1, "h1", "v1"), (2, "h2", "v2"), (3, "h3", "v1")], have.schema)
    assert sorted((r.id, r.hash, r.version) for r in states.invalidated(have, inputs, "id", ["hash", "version"]).collect()) == [(1, "h1", "v1"), (2, None, None), (3, None, None)]
    parts = [(spark.createDataFrame([(1, 5), (2, 50), (3, 1), (4, None)], "id long, a long"), "a"), (spark.createDataFrame([(1, 99)], "id long, b long"), "b")]
    done = spark.createDataFrame([(1, 98), (2, 50), (4, 1)], "id long, done_s long")
    assert sorted(r.id for r in states.changed_since(parts, done, "id").collect()) == [1, 3]
    assert [r.id for r in states.unchanged_inputs(have.where("id < 3"), inputs, "id").collect()] == [1, 2]


def test_normalized_fields_drop_what_came_from_the_old(spark):
    rows = spark.createDataFrame([(1, "a", None, "v"), (2, "b", "s", "v"), (3, None, None, "v"), (4, "d", None, "v")], "id long, title string, summary string, vector string")
    new = spark.createDataFrame([(1, "a", None), (2, "b", "S"), (3, "c", None)], "id long, title string, summary string")
    got = sorted((r.id, r.title, r.summary, r.vector) for r in states.renormalized(rows, new, "id", ["title", "summary"], ["vector"]).collect())
    assert got == [(1, "a", None, "v"), (2, "b", "S", None), (3, "c", None, None), (4, "d", None, "v")]
