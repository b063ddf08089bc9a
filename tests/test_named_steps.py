"""An adjacency of edges that are named by kind and ends keeps no ids, and gives the same steps."""

from pyspark.sql import functions as F

from rippleline.operators import adjacency


def test_ids_are_made_anew(spark, tmp_path):
    n = 3000
    made = spark.range(n).select(F.concat(F.lit("S"), F.col("id") % 40).alias("src"), F.concat(F.lit("P"), F.col("id")).alias("dst"), F.when(F.col("id") % 2 == 0, "Publishes").otherwise("Consumes").alias("kind"), F.array(F.lit("R1")).alias("provenance"))
    hub = spark.range(1500).select(F.concat(F.lit("C"), F.col("id")).alias("src"), F.lit("K:x").alias("dst"), F.lit("ReadsKey").alias("kind"), F.array().cast("array<string>").alias("provenance"))
    edges = made.union(hub).withColumn("id", F.concat_ws("|", "kind", "src", "dst"))
    adjacency.write(edges, str(tmp_path / "kept"), hub=500)
    adjacency.write(edges, str(tmp_path / "named"), hub=500, by_ends=True)
    assert "edge_id" not in spark.read.parquet(str(tmp_path / "named/steps")).columns
    kept, named = (adjacency.read(spark, str(tmp_path / x)) for x in ("kept", "named"))
    assert named.hubs.collect() == kept.hubs.collect() != []
    rows = [sorted(map(str, a.rows.select(*adjacency.STEP).collect())) for a in (kept, named)]
    assert rows[0] == rows[1] and len(rows[0]) == 2 * (n + 1500)
    for node in ("K:x", "S7", "P12", "C3"):
        asked = [sorted(map(str, a.steps_of(node).select(*adjacency.STEP).collect())) for a in (kept, named)]
        assert asked[0] == asked[1] != []
    assert max(named.rows.groupBy("slot").count().toPandas()["count"]) <= 600
