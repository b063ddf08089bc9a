"""Registry gaps of services that share long lists: the same rows as an anti-join of all pairs, without moving the pairs."""

import pytest

from rippleline.operators import assemble
from rippleline.plans import catalogue
from rippleline.runtime import setting


def moved(spark):
    """Rows that all stages so far wrote to shuffles."""
    store = spark._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_pairs_are_not_moved(spark, tmp_path):
    suppliers, parts = 1000, 10_000
    spark.range(suppliers).selectExpr("id as s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(parts).selectExpr("id as p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(5000).selectExpr("id % 1000 as l_suppkey", "id % 100 + 100 * (id % 7) as l_partkey").union(spark.sql("select id, id + 1 from range(300)")).write.parquet(f"{tmp_path}/lineitem.parquet")
    seen = {(i % 1000, i % 100 + 100 * (i % 7)) for i in range(5000)}
    before = moved(spark)
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        got = [(r["service"], r["topic"]) for r in catalogue.QUERIES["registry_fill_gaps"](spark, str(tmp_path)).collect()]
    want = [(f"S{s}", f"P{p}") for s in range(suppliers) for p in range(s % 100, parts, 100) if (s, p) not in seen]
    assert sorted(got) == sorted(want) and len(want) > 90_000
    assert moved(spark) - before < suppliers * parts // 100 // 2


@pytest.mark.parametrize("per_block", [1, 3, 1024])
def test_equals_anti_join(spark, per_block):
    """Repeated services and topics, services of several lists or of none, all of a list seen, other kinds, lists of one topic."""
    services = [("a", 1), ("a", 2), ("b", 1), ("b", 1), ("c", 3), ("d", 9)]
    lists = [(1, f"t{i % 17}") for i in range(20)] + [(2, f"t{i}") for i in range(10, 30)] + [(3, "t5"), (4, "t6")]
    shown = [("a", "t1"), ("a", "t1"), ("a", "t12"), ("b", "t3"), ("b", "t99"), ("z", "t1"), ("c", "t5")]
    seen = [("Publishes", *x) for x in shown] + [("Consumes", "a", "t2"), ("Publishes", None, "t1"), ("Publishes", "a", None)]
    got = assemble.shared_registry_edges(
        spark.createDataFrame(services, "service string, list long"), spark.createDataFrame(lists, "list long, topic string"), spark.createDataFrame(seen, "kind string, src string, dst string"), per_block=per_block
    )
    want = [("Publishes", s, t, "<registry>", 0) for s, k in services for m, t in lists if k == m and (s, t) not in shown]
    assert sorted(map(tuple, got.collect())) == sorted(want)
