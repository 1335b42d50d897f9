"""The driver's contract, and a sample of queries against the other engine."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0 and rows.columns[0] == "story_id"


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["agg1_story_summary", "agg8_consensus_counts", "flt15_eligible_groups", "j13_validity", "j7_candidates", "win6_top_claims", "srt9_waves", "snk2_diff_upsert", "gr1_components", "gr2_roots", "c4_cosine", "st_sessions", "clu11_conflict_rich", "c16_partition", "sup21_outcomes", "agg20_threshold_sweep", "snk9_create_sources", "snk11_merge_plan", "str26_context", "agg14_missing_rows", "snk2_written", "st4_lease_runs", "str4_topic_key", "sup11_spans", "src15_vectors", "src1_unchanged_feeds", "str11_language"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    tidy = lambda v: round(float(v), 6) if isinstance(v, float) else v
    assert sorted(repr(tuple(tidy(v) for v in r)) for r in got.select(*names).collect()) == sorted(repr(tuple(tidy(v) for v in r)) for r in want)


def test_filters_reach_the_scan(spark):
    plan = entry.queries()["tpch_q6"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_discount)" in plan
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double>" in plan


def test_stored_steps_are_deleted_at_the_end(spark):
    from newsprism.storage import Scratch, stored

    with Scratch(spark) as scratch:
        step = stored(spark.range(3).toDF("x"), "step")
        kept = stored(step.selectExpr("x + 1 as x"), "kept", keep=True)
        (path,) = scratch.paths
    assert sorted(r.x for r in kept.collect()) == [1, 2, 3]
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def test_unmarked_cluster_needs_a_shared_folder(spark, monkeypatch):
    from newsprism import storage

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(Conf)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.folder(Session())
