"""Questions about nodes, or edges of small tables, don't write the trade graph's edges."""

from pyspark.sql import functions as F

from rippleline.plans import catalogue, tradegraph


def test_names_and_origins_write_no_edges(spark, sf, monkeypatch):
    monkeypatch.setattr(tradegraph, "_BUILT", {})
    monkeypatch.setattr(tradegraph, "_NAMES", {})

    def written(df, name, *rest, **more):
        raise AssertionError(f"{name} written")

    monkeypatch.setattr(tradegraph, "materialize", written)
    assert catalogue.QUERIES["find_names"](spark, sf).count() > 0
    found = catalogue.QUERIES["origin_tables_of_all"](spark, sf)
    assert found.where("tables <> ''").count() == 30
    assert "lineitem" not in found._jdf.queryExecution().executedPlan().toString()


def test_tasks_that_take_out_duplicates_are_bounded(spark, sf, monkeypatch):
    """As many tasks as lines ask for, each with its share of pairs, and no pair twice."""
    monkeypatch.setattr(tradegraph, "PAIRS_A_TASK", 500, raising=False)
    pairs = tradegraph.edges(spark, sf).where(F.col("kind").isin("Publishes", "Consumes"))
    per_task = [r["count"] for r in pairs.groupBy("kind", F.spark_partition_id().alias("task")).count().collect()]
    assert len(per_task) > 12 and max(per_task) <= 2 * 500
    assert pairs.count() == pairs.select("kind", "src", "dst").distinct().count() == sum(per_task)


def test_degrees_write_no_edges(spark, sf, tmp_path):
    here = tmp_path / "tables"
    here.symlink_to(sf)
    assert catalogue.QUERIES["symbol_degree"](spark, str(here)).count() > 0
    assert "edges" not in vars(tradegraph.trade_graph(spark, str(here)))
