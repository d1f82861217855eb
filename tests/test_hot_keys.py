"""Queries on tables of which many rows share a key, against their SQL, and how many rows they handle on the way."""

import duckdb

from talkgrid.operators import graph
from talkgrid.operators import signal as G
from talkgrid.plans.registry import ORACLES, QUERIES


def both(spark, folder, name, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    got, want = sorted(map(tuple, df.collect()), key=str), sorted(con.execute(ORACLES[name]).fetchall(), key=str)
    assert got == want
    return df


def produced(df):
    """The most rows that any operator of the plan has put out."""
    def walk(p):
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            yield from walk(p.executedPlan())
        elif p.getClass().getSimpleName().endswith("QueryStageExec"):
            yield from walk(p.plan())
        else:
            m = p.metrics().get("numOutputRows")
            yield m.get().value() if m.isDefined() else 0
            for i in range(p.children().size()):
                yield from walk(p.children().apply(i))

    return max(walk(df._jdf.queryExecution().executedPlan()))


def test_people_of_one_key_are_one_row(spark, tmp_path):
    rows = [(i, f" Name{i % 7}" if i % 3 else None, "SEG", i % 4 if i % 5 else None) for i in range(2000)]
    df = both(spark, tmp_path, "attendee_people", "customer", rows, "c_custkey long, c_name string, c_mktsegment string, c_nationkey int")
    assert produced(df) <= 4 * len(rows)


def test_gaps_stay_runs(spark, tmp_path):
    rows = [(0, 1, 1.5), (10_000_000_000, 1, 2.0), (5, 2, 3.0), (5, 2, 4.0), (9, 2, None), (7, None, 1.0), (None, 3, 2.5), (4, 3, 0.5), (6, 4, None)]
    both(spark, tmp_path, "gap_filled", "events", rows, "event_id long, user_id long, value double")
    few = spark.createDataFrame([(i, u, v) for i, u, v in rows if u == 2], "event_id long, user_id long, value double")
    got = sorted((r.event_id, r.value) for r in G.gap_fill(few.where("value is null or value < 4"), "user_id", "event_id", "value").collect() if r.value is not None)
    assert got == [(5, 3.0), (6, 0.0), (7, 0.0), (8, 0.0)]
    assert G.gap_fill(few, "user_id", "event_id", "value").count() == 6  # both rows of 5, and the rest


def test_alias_pairs_are_not_shuffled(spark, tmp_path):
    rows = [(i, f"b{i % 2}" if i % 9 else None, ("big", "Small ", "", None)[i % 4], ("big", "small", "x", " ")[i % 5 % 4]) for i in range(300)] + [(7, "b0", "big", "other"), (7, "b1", "x", None)]
    df = both(spark, tmp_path, "alias_matches", "part", rows, "p_partkey long, p_brand string, p_name string, p_type string")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # nothing gathers what the join gives


def test_alias_pairs_take_little_disk(spark, tmp_path):
    n = 2500
    rows = [(7 * i, "b0", f"name {i % 16}", "Large" if i % 2 else " large") for i in range(n)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    QUERIES["alias_matches"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    pairs = f"from '{tmp_path}/out/*.parquet'"
    assert duckdb.sql(f"select count(*), (select count(*) from (select distinct * {pairs})) {pairs}").fetchall() == [(n * n, n * n)]
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 0.3 * n * n


def test_alias_pairs_of_many_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graph, "ALIAS_BLOCK", 2)
    monkeypatch.setattr(graph, "ALIAS_CELL", 3)
    rows = [(i if i % 50 else None, f"b{i % 2}" if i % 9 else None, ("big", "Small ", "", None)[i % 4], ("big", "small", "x", " ")[i % 5 % 4]) for i in range(200)] + [(7, "b0", "big", "other"), (7, "b1", "x", None)]
    both(spark, tmp_path, "alias_matches", "part", rows, "p_partkey long, p_brand string, p_name string, p_type string")
