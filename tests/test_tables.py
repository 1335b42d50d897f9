"""Tables with versions: writes, readers of old versions, and writers that race."""

import threading

import pytest
from pyspark.sql import functions as F

from newsprism import tables
from newsprism.storage import new_path

SCHEMA = "id long, name string, size int, made string"


@pytest.fixture
def table(spark):
    return tables.Table.create(spark, new_path(spark, "table"), spark.createDataFrame([], SCHEMA).schema, ["id"], buckets=4)


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def held(table, version=None):
    return sorted((r.id, r.name, r.size, r.made) for r in table.read(version).collect())


def test_writes_and_versions(spark, table):
    assert held(table) == [] and table.version() == 0
    with pytest.raises(FileExistsError):
        tables.Table.create(spark, table.path, table.schema, ["id"])
    first = tables.insert_absent(table, rows(spark, (1, "a", 1, "m1"), (2, "b", 2, "m2"), (2, "c", 9, None)))
    assert first.version == 1 and first.metrics == {"insert": 2} and held(table) == [(1, "a", 1, "m1"), (2, "b", 2, "m2")]
    again = tables.insert_absent(table, rows(spark, (2, "z", 0, None), (None, "n", 0, None)))
    assert again.metrics["insert"] == 1 and len(held_ids(table)) == 3

    changed = tables.upsert(table, rows(spark, (1, "A", 1, None), (2, "b", 2, None), (3, "d", 3, None)).drop("made"), ["name", "size"], {"made": ["name"]})
    assert {k: v for k, v in changed.metrics.items() if k != "keep"} == {"insert": 1, "update": 1, "unchanged": 1}
    assert [r for r in held_ids(table) if r[0] is not None] == [(1, "A", 1, None), (2, "b", 2, "m2"), (3, "d", 3, None)]
    assert held(table, 1) == [(1, "a", 1, "m1"), (2, "b", 2, "m2")]  # readers of a version keep it

    gone = tables.delete_absent(table, spark.createDataFrame([(2,), (3,), (77,)], "id long"))
    assert gone.metrics == {"keep": 2, "delete": 2} and [r[0] for r in held(table)] == [2, 3]
    patched = tables.patch(table, spark.createDataFrame([(2, ("B2", True)), (3, (None, False)), (9, ("x", True))], "id long, name struct<value string, present boolean>"), ["name"])
    assert patched.version == 5 and [r[1] for r in held(table)] == ["B2", "d"]
    swapped = tables.replace(table, rows(spark, (3, "new", 1, None), (3, "new too", 1, None)), spark.createDataFrame([(3,), (2,)], "id long"))
    assert swapped.metrics == {"delete": 2, "insert": 2} and [r[1] for r in held(table)] == ["new", "new too"]
    assert table.expire(keep=2) > 0 and [r[1] for r in held(table)] == ["new", "new too"]


def held_ids(table):
    return sorted(((r.id, r.name, r.size, r.made) for r in table.read().collect()), key=lambda r: (r[0] is None, r[0] or 0))


def test_two_writers_race(spark, table, monkeypatch):
    """Both read version 1 and change one row; the second to commit does its work again."""
    table.append(rows(spark, (1, "start", 0, None)))
    both = threading.Barrier(2)
    attempts = []
    commit = tables.Table._commit

    def meet(self, base, *rest, **how):
        attempts.append(base.version)
        if attempts.count(1) <= 2 and base.version == 1:
            both.wait(120)
        return commit(self, base, *rest, **how)

    monkeypatch.setattr(tables.Table, "_commit", meet)

    def add(name):
        def more(old, new):
            return old.withColumns({"size": F.col("size") + 1, "name": F.concat("name", F.lit(f"+{name}"))})

        tables.Table(spark, table.path).change(rows(spark, (1, name, 0, None)), more, name)

    threads = [threading.Thread(target=add, args=(n,)) for n in ("x", "y")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    (row,) = held(table)
    assert row[2] == 2 and row[1] in ("start+x+y", "start+y+x")  # no update is lost
    assert sorted(attempts) == [1, 1, 2] and table.version() == 3
    assert held(table, 1) == [(1, "start", 0, None)]


def test_writers_of_other_buckets_dont_wait(spark, table):
    names = {}
    for k in range(40):
        names.setdefault(spark.range(1).select(F.pmod(F.xxhash64(F.lit(k).cast("long")), F.lit(4))).first()[0], k)
    a, b = list(names.values())[:2]
    base = table.snapshot()
    parts, _ = table._write(rows(spark, (a, "a", 1, None)))
    tables.insert_absent(table, rows(spark, (b, "b", 1, None)))
    assert table._commit(base, parts, parts, "late", {}, append=False) == 2
    assert [r[0] for r in held(table)] == sorted((a, b))
    with pytest.raises(tables.Conflict):
        table._commit(base, parts, parts, "stale", {}, append=False)


def test_one_of_many_puts_a_file(spark):
    files = tables.Files(spark)
    folder = new_path(spark, "log")
    files.system(folder).mkdirs(files.path(folder))
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append((k, files.put_new(f"{folder}/x", str(k))))) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    (winner,) = [k for k, ok in won if ok]
    assert files.read(f"{folder}/x") == str(winner) and files.names(folder) == ["x"]
    # the way of file systems other than a local disk
    for name, want in (("y", True), ("x", False)):
        stream = files.system(folder).create(files.path(f"{folder}/draft"), True)
        stream.close()
        assert files.rename_new(f"{folder}/draft", f"{folder}/{name}") is want


def test_generations_and_plans(spark):
    schema = spark.createDataFrame([], "story long, claim long, generation int").schema
    table = tables.Table.create(spark, new_path(spark, "claims"), schema, ["story"], 3)
    claims = lambda *v: spark.createDataFrame(list(v), "story long, claim long").withColumn("generation", F.lit(0))
    tables.new_generation(table, claims((1, 10), (1, 11), (2, 20)))
    tables.new_generation(table, claims((1, 12)))
    assert sorted((r.story, r.claim, r.generation) for r in table.read().collect()) == [(1, 10, 1), (1, 11, 1), (1, 12, 2), (2, 20, 1)]

    kind = spark.createDataFrame([], "slug string, type string, priority int").schema
    sources = tables.Table.create(spark, new_path(spark, "sources"), kind, ["slug"])
    wanted = lambda *v: spark.createDataFrame(list(v), kind)
    assert tables.reconcile(sources, wanted(("a", "NEWS", 1), ("b", "NGO", 2)), ["type", "priority"], ["type"]).metrics == {"insert": 2}
    assert tables.reconcile(sources, wanted(("a", "NEWS", 5)), ["type", "priority"], ["type"]).metrics["update"] == 1
    with pytest.raises(tables.Blocked, match="'b'"):
        tables.reconcile(sources, wanted(("a", "NEWS", 6), ("b", "NEWS", 2)), ["type", "priority"], ["type"])
    assert sorted(tuple(r) for r in sources.read().collect()) == [("a", "NEWS", 5), ("b", "NGO", 2)]


def test_results_of_changed_inputs_are_dropped(spark):
    schema = spark.createDataFrame([], "id long, input_hash string, value int").schema
    table = tables.Table.create(spark, new_path(spark, "results"), schema, ["id"])
    now = {1: "a", 2: "b", 3: "c"}
    inputs = lambda: spark.createDataFrame(list(now.items()), "id long, input_hash string")
    results = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (4, "d", 40)], schema)
    now[2] = "edited"
    assert tables.commit_unchanged(table, results, inputs).metrics == {"insert": 1}
    assert [tuple(r) for r in table.read().collect()] == [(1, "a", 10)]
