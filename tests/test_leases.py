"""Readers and pruning; counters of a sync."""

import os

import pytest

from rippleline.api import Engine
from rippleline.plans import extraction
from rippleline.schema import FILES, RAW_EDGES, REGISTRY
from rippleline.sources import store
from rippleline.sources.config import Config
from rippleline.sync import build


@pytest.fixture
def site(spark, sf, tmp_path):
    path = str(tmp_path / "store")
    made, _ = extraction.built(spark, sf)
    store.save(made, path)
    return Config(store=path), made, path


def test_a_snapshot_outlives_syncs(spark, site):
    config, made, path = site
    with Engine(spark, config) as engine:
        want = engine.impact("geo.nation_3", 2).collect()
    assert want and not os.listdir(f"{path}/_leases")
    with Engine(spark, config).snapshot() as held:
        asked = held.impact("geo.nation_3", 2)  # a plan; nothing of its last step is read yet
        at = store.versions(spark, path)[0]
        for _ in range(3):
            store.save(made, path)
            store.prune(spark, path, keep=1)
        assert store.versions(spark, path)[0] == at and len(store.versions(spark, path)) == 2
        assert asked.collect() == want and held.find("geo.nation_3").name == "NATION_3"
    assert store.prune(spark, path, keep=1) == [at] and len(store.versions(spark, path)) == 1


def test_leases_end_and_go_on(spark, site):
    config, made, path = site
    first, _ = store.acquire(spark, path, hold=-1)  # of a reader that died
    store.save(made, path)
    assert store.leased(spark, path) == set() and os.listdir(f"{path}/_leases") == []
    assert store.prune(spark, path, keep=1, min_age=3600) == []
    assert store.prune(spark, path, keep=1) == [first]
    engine = Engine(spark, config, hold=600)
    files = lambda: [n for n in os.listdir(f"{path}/_leases") if not n.startswith(".")]
    assert engine.store.nodes.count() and len(files()) == 1
    one, engine._renew = files(), 0.0
    assert engine.store.nodes.count() and len(files()) == 1 and files() != one  # anew, and the old one given back
    second = store.versions(spark, path)[0]
    store.save(made, path)
    assert store.prune(spark, path, keep=1) == []
    assert engine.store.nodes.count() and store.prune(spark, path, keep=1) == [second]
    engine.close()
    assert files() == []
    with Engine(spark, config, hold=0) as reader:
        assert reader.store.nodes.count() and files() == []


def test_a_prune_that_died_is_finished(spark, site):
    _, made, path = site
    first = store.versions(spark, path)[0]
    store.save(made, path)
    os.rename(f"{path}/{first}/_done", f"{path}/{first}/_going")
    assert first not in store.versions(spark, path)
    assert store.prune(spark, path) == [first] and not os.path.exists(f"{path}/{first}")


def test_a_lease_that_came_in_between_is_seen(spark, site, monkeypatch):
    """A reader leases a version just before it is hidden: it comes back."""
    _, made, path = site
    first, lease = store.acquire(spark, path)
    store.save(made, path)
    real, calls = store.leased, []

    def late(*args):
        calls.append(1)
        return real(*args) if len(calls) > 1 else set()

    monkeypatch.setattr(store, "leased", late)
    assert store.prune(spark, path, keep=1) == [] and first in store.versions(spark, path)
    store.release(spark, lease)
    assert store.prune(spark, path, keep=1) == [first]


def test_counters_of_nothing(spark):
    empty = lambda s: spark.createDataFrame([], s)
    made, counters = build(spark, empty(FILES), empty(FILES), [empty(RAW_EDGES)], empty("seq array<string>, service string"), empty(REGISTRY), empty("service string, has_dump boolean"))
    assert set(counters.first().asDict().values()) == {0} and made.nodes.count() == made.edges.count() == 0


def test_counters_cost_no_job(spark, sf):
    _, counters = extraction.built(spark, sf)
    assert "Scan parquet" not in counters._jdf.queryExecution().executedPlan().toString()
