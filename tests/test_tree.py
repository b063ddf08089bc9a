"""The data source of source trees."""

import os
import time

import pyarrow.fs
import pytest

from rippleline.runtime import setting
from rippleline.sources import tree
from rippleline.sources.config import load_config
from rippleline.sources.files import scan_tree
from rippleline.streaming import ingest
from rippleline.sync import sync

FILES = {
    "a.go": "1", "b/c.rs": "2", "b/d/e.cpp": "3", "b/d/f.txt": "4", "b/vendor/g.go": "5", "node_modules/h/i.go": "6", "b/j.HPP": "7", "b/empty.go": "",
    "b/vendored/k.h": "8", "x.y/z w+%.cc": "9", "target": "10", "_hidden.go": "11", ".dot.go": "12", "noext": "13", "b/d/target.go": "14",
}


@pytest.fixture
def root(tmp_path):
    for name, text in FILES.items():
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text(text)
    (tmp_path / "t/b/bad.go").write_bytes(b"\xff")
    for i in range(200):
        (tmp_path / f"t/node_modules/m{i}").mkdir()
        (tmp_path / f"t/node_modules/m{i}/x.go").write_text("no")
    return str(tmp_path / "t")


class Counting:
    """A store that tells which folders were listed."""

    def __init__(self):
        self.store, self.seen = pyarrow.fs.LocalFileSystem(), []

    def get_file_info(self, selector):
        self.seen.append(selector.base_dir)
        return self.store.get_file_info(selector)


def test_skipped_folders_are_not_listed(root):
    wanted, store = tree.Wanted(root, ("go", "rust", "cpp")), Counting()
    names = sorted(wanted.shown(i.path)[len(root) + 1 :] for i, _ in tree.walk(store, wanted.base, wanted))
    assert names == ["a.go", "b/bad.go", "b/c.rs", "b/d/e.cpp", "b/d/target.go", "b/vendored/k.h", "x.y/z w+%.cc"]
    assert sorted(x[len(root) :] for x in store.seen) == ["", "/b", "/b/d", "/b/vendored", "/x.y"]
    only, store = tree.Wanted("file://" + root, ("cpp",), prefix=f"{root}/b/d"), Counting()
    assert [i.base_name for i, _ in tree.walk(store, only.base, only)] == ["e.cpp"]
    assert sorted(x[len(root) :] for x in store.seen) == ["", "/b", "/b/d"]


@pytest.mark.parametrize("fan", [1, 2, 3, 100])
def test_each_folder_is_walked_once(root, fan):
    wanted, store = tree.Wanted(root, ("go", "rust", "cpp")), pyarrow.fs.LocalFileSystem()
    names = [i.path for f, deep in tree.starts(store, wanted, fan) for i, _ in tree.walk(store, f, wanted, deep)]
    assert len(names) == len(set(names)) == 7


def test_same_files_as_the_scan(spark, root, tmp_path):
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(tree.pruned_tree(spark, root, "s", 3)) == rows(scan_tree(spark, root, "s", 3))
    assert tree.pruned_tree(spark, str(tmp_path / "none"), "s").count() == 0


def test_filters_are_taken(spark, root):
    with setting(spark, "spark.sql.python.filterPushdown.enabled", "true"):
        spark.dataSource.register(tree.SourceTree)
        found = spark.read.format("source_tree").option("filters", True).load(root).where("lang in ('cpp', 'go')").where(f"path like '{root}/b/%'").select("path", "lang")
        assert "PushedFilters: []" not in found._jdf.queryExecution().toString()
        assert sorted(r.path[len(root) :] for r in found.collect()) == ["/b/bad.go", "/b/d/e.cpp", "/b/d/target.go", "/b/vendored/k.h"]
    reader = tree.FilteringReader({"path": root})
    other = tree.EqualTo(("length",), 1)
    assert list(reader.pushFilters([tree.In(("lang",), ("go", "sql")), tree.StringStartsWith(("path",), f"{root}/b/"), tree.StringStartsWith(("path",), f"{root}/a"), other])) == [tree.StringStartsWith(("path",), f"{root}/a"), other]
    assert (reader.wanted.languages, reader.wanted.prefix) == (("go",), f"{root}/b/")


def test_stream_sees_rewritten_files(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    (src / "vendor").mkdir(parents=True)
    line = 'FutureRecord::to("%s");\n'
    (src / "a.rs").write_text(line % "one")
    (src / "vendor/n.rs").write_text(line % "no")
    run = lambda: ingest.start(tree.pruned_stream(spark, str(src), "svc", 0.2), out, str(tmp_path / "ck")).awaitTermination()
    now = lambda: {r.dst for r in ingest.current_edges(spark, out).collect()}
    time.sleep(0.4)
    run()
    assert now() == {"one"}
    (src / "a.rs").write_text(line % "two")
    (src / "b.rs").write_text(line % "three")
    time.sleep(0.4)
    run()
    assert now() == {"two", "three"}
    (src / "a.rs").unlink()
    assert ingest.catch_up(spark, str(src), "svc", out) == (0, 1) and now() == {"three"}
    assert os.path.exists(src / "b.rs")


def test_a_sync_that_prunes(spark, tmp_path):
    for name, text in (("db/a.sql", "create procedure P1 as begin null; end;\n"), ("db/vendor/b.sql", "create procedure P2 as begin null; end;\n"), ("code/a.rs", 'FutureRecord::to("one");\n'), ("code/target/b.rs", 'FutureRecord::to("no");\n')):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "code/bad.rs").write_bytes(b"\xff")
    text = '[store]\npath = "out"\n' + "".join(f'[[sources]]\nkind = "{k}"\npath = "{p}"\nservice = "{p}"\n' for k, p in (("sql", "db"), ("code", "code")))
    reports, edges = [], []
    for listing in ("spark", "pruned"):
        (tmp_path / "c.toml").write_text(f'listing = "{listing}"\n{text}')
        made, report = sync(spark, load_config(str(tmp_path / "c.toml")))
        reports.append(report)
        edges.append(sorted(map(str, made.edges.collect())))
    assert reports[0] == reports[1] and reports[0].defs == 1 and reports[0].unreadable == 1 and edges[0] == edges[1] and len(edges[0]) == 2
    (tmp_path / "c.toml").write_text(f'listing = "other"\n{text}')
    with pytest.raises(ValueError, match="unknown listing"):
        load_config(str(tmp_path / "c.toml"))


def test_a_wide_level_makes_no_more_tasks_than_its_fan(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"t/s{i}").mkdir(parents=True)
        (tmp_path / f"t/s{i}/a.go").write_text(str(i))
    spark.dataSource.register(tree.SourceTree)
    for fan in (0, 1, 3, 100):
        read = spark.read.format("source_tree").option("fan", str(fan)).load(str(tmp_path / "t"))
        assert read.rdd.getNumPartitions() <= max(fan, 1) and sorted(int(bytes(r.content)) for r in read.collect()) == list(range(40))
