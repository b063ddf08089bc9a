"""Periodic runs, change points and the n-gram join against brute force."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from rippleline.llm import changepoints, ngram_join, runs
from rippleline.llm.queries import ORACLE_SQL, QUERIES

WIDE_DOCS = "doc_id long, text string, Runs string, COLLAPSED int, _found int, _FOUND_ int, n_shingles int, component_id string"


def brute_runs(v, least=12):
    """All runs: for each period, maximal stretches where words that far apart are the same; the smallest period counts."""
    found = []
    for p in range(1, len(v) // 2 + 1):
        q = 0
        while q < len(v) - p:
            s = q
            while q < len(v) - p and v[q] == v[q + p]:
                q += 1
            w = v[s : q + p]
            if q - s >= p and len(w) >= least and not any(w[k:] == w[:-k] for k in range(1, p)):
                found.append((s, len(w), p))
            q += q == s
    return sorted(found)


def test_runs_by_brute_force():
    r = random.Random(3)
    for _ in range(3000):
        n, k = r.randrange(0, 60), r.choice([1, 2, 2, 3, 5])
        v = [r.randrange(k) for _ in range(n)]
        if n and r.random() < 0.5:
            a, p = r.randrange(n), 1 + r.randrange(8)
            v = [v[min(n - 1, a + (i - a) % p)] if i >= a else v[i] for i in range(n)]
        least = r.choice([1, 2, 12])
        assert runs.runs(v, least) == brute_runs(v, least)


def test_next_smaller_suffixes():
    r = random.Random(4)
    for _ in range(500):
        v = [r.randrange(r.choice([1, 2, 3])) for _ in range(r.randrange(1, 40))]
        smaller, agree = runs.lyndon_array(v)
        for i in range(len(v)):
            want = next((j for j in range(i + 1, len(v)) if v[j:] < v[i:]), len(v))
            assert smaller[i] == want
            if want < len(v):
                assert v[i : i + agree[i]] == v[want : want + agree[i]] and v[i : i + agree[i] + 1] != v[want : want + agree[i] + 1]


@pytest.mark.parametrize("v", [[0] * 50_000, [0, 1] * 25_000, [*range(25_000)] * 2])
def test_runs_of_long_periodic_texts(v):
    p = 1 if v[1] == 0 else 2 if v[2] == 0 else 25_000
    assert runs.runs(v) == [(0, 50_000, p)]


def brute_digest(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words) if n < 600 else runs.runs(runs.numbered(b" ".join(words))[0])
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    best = min(((-m, s, p) for s, m, p in found), default=None)
    first = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    every = "".join(f"{s},{m},{p}\n" for s, m, p in found)
    return (doc_id, len(found), *first, hashlib.sha256(every.encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def test_runs_query(spark, sf):
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    got = sorted(map(tuple, QUERIES["op11_word_runs"](spark, sf).collect()))
    assert got == sorted(brute_digest(d, x) for d, x in zip(t["doc_id"], t["text"]))
    assert sum(r[1] for r in got) > 10


def test_runs_of_odd_documents(spark):
    texts = [None, "", " \n\t ", "one", "a b " * 6, "a b " * 5 + "a", "x " * 11, "x " * 12, "  é " * 8, "zwei " * 40_000, "zwei " * 40_000, "a b c " * 9]
    rows = [(i, t, "r", 1, 2, 3, 4, "c") for i, t in enumerate(texts)] + [(None, "a " * 20, None, None, None, None, None, None), (4, "b " * 13, "r", 1, 2, 3, 4, "c"), (4, "b " * 13, "r", 1, 2, 3, 4, "c")]
    df = spark.createDataFrame(rows, WIDE_DOCS)
    got = sorted((tuple(r) for r in runs.digest(df).collect()), key=str)
    assert got == sorted((brute_digest(r[0], r[1]) for r in rows), key=str)
    kept = runs.annotate(df)
    assert [c for c in kept.columns if c.lower() == "runs"] == ["runs"] and {"_found", "_FOUND_", "n_shingles"} <= set(kept.columns)
    by = {r.doc_id: r for r in kept.collect() if r.doc_id is not None}
    assert by[0].collapsed is None and by[1].collapsed == "" and by[9].collapsed == "zwei" and by[7].collapsed == "x" and by[5].runs == []
    assert runs.annotate(df.limit(0)).count() == 0 and runs.digest(df.limit(0)).count() == 0


def brute_segments(x, shortest=5, penalty=10_000):
    """Dynamic program over whole histories: least cost, then fewest segments, then earliest starts from the last back."""
    s, q = [0], [0]
    for v in x:
        s.append(s[-1] + v)
        q.append(q[-1] + v * v)

    def price(i, j):
        n, a, b = j - i, s[j] - s[i], q[j] - q[i]
        spread = 1 + (n * b - a * a) // (n * n)
        return n * math.floor(1000 * math.log(spread)), spread

    best = {0: (0, 0, ())}
    for j in range(1, len(x) + 1):
        ways = [(c + price(i, j)[0] + penalty * (i > 0), k + 1, (i, *past)) for i, (c, k, past) in best.items() if j - i >= shortest or (i == 0 and j == len(x))]
        if ways:
            best[j] = min(ways)
    cost, k, starts = best[len(x)]
    cuts = [*reversed(starts), len(x)]
    return [(n + 1, a, b - a, s[b] - s[a], price(a, b)[1], price(a, b)[0], k, cost) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def test_segments_by_brute_force(spark):
    r = random.Random(1)
    rows = []
    for key in range(70):
        level, x = 0, []
        for _ in range(r.choice([1, 2, 4, 5, 6, 9, 10, 11, 30, 90])):
            level = r.choice([0, 0, 5, 1000, -30]) if r.random() < 0.1 else level
            x.append((level + r.randrange(r.choice([1, 3, 50]))) * (10**6 if key % 7 == 0 else key % 5 > 0))
        rows.append((key, 100, x))
    got = {}
    for z in changepoints.segments(spark.createDataFrame(rows, "key long, first int, totals array<long>")).collect():
        got.setdefault(z.key, []).append((z.segment_no, z.first_day - 100, z.n_days, z.total, z.spread, z.cost, z.n_segments, z.best_cost))
    for key, _, x in rows:
        assert sorted(got[key]) == brute_segments(x), x
    assert max(len(v) for v in got.values()) > 2


def test_change_points_query(spark, sf):
    c = duckdb.connect()
    c.sql(f"create view sale_lines as select * from '{sf}/sale_lines.parquet'")
    want = c.sql(ORACLE_SQL["op12_change_points"])
    got = QUERIES["op12_change_points"](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_change_points_of_odd_rows(spark):
    day = lambda d: f"timestamp_ntz'2024-01-{d:02d} 23:59:59'"
    rows = [("null", 3, "'kept'", day(2)), ("null", 4, "'swapped'", day(4)), ("1", "null", "'kept'", day(1)), ("1", 7, "'kept'", "null"), ("1", 7, "null", day(1)), ("1", 7, "'returned'", day(1)), *[("2", 5, "'kept'", day(9))] * 2]
    df = spark.sql("select * from values " + ",".join(f"(cast({v} as bigint), cast({q} as int), {f}, {t}, 1, 2)" for v, q, f, t in rows) + " as t(vendor_id, quantity, flag, shipped_at, cost, Spread)")
    got = sorted((tuple(r) for r in changepoints.of_vendors(df).collect()), key=str)
    assert got == sorted([(2, 1, 19731, 1, 10, 1, 0, 1, 0), (None, 1, 19724, 3, 7, *brute_segments([3, 0, 4])[0][4:6], 1, brute_segments([3, 0, 4])[0][7])], key=str)
    assert changepoints.of_vendors(df.limit(0)).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def near(a, b, percent=90):
    return 100 * len(a & b) >= percent * len(a | b)


def classes_of(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    return [root(i) for i in range(n)]


def brute_join(rows):
    sets = [shingles(t) for _, t in rows]
    holders, links = {}, []
    for i, s in enumerate(sets):
        links += [(i, j) for j in {j for g in s for j in holders.get(g, ())} if near(s, sets[j])]
        for g in s:
            holders.setdefault(g, []).append(i)
    of, least = classes_of(len(rows), links), {}
    for c, (d, _) in zip(of, rows):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    return sorted([(d, len(s), least.get(c) if s else d) for c, s, (d, _) in zip(of, sets, rows)], key=str)


def test_tries_by_brute_force():
    r = random.Random(2)
    for _ in range(60):
        pool = np.sort(np.array([r.getrandbits(64) for _ in range(60)], np.uint64))
        base = [set(r.sample(range(60), r.choice([3, 12, 30, 40]))) for _ in range(3)]
        sets = []
        for _ in range(30):
            s = set(r.choice(base))
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                s ^= {r.randrange(60)}
            if s:
                sets.append(frozenset(s))
        rows, percent = [pool[sorted(s)] for s in sets], r.choice([50, 80, 90, 100])
        want = [(j, i) for i, s in enumerate(sets) for j in range(i) if near(s, sets[j], percent)]
        trie = ngram_join.Trie(percent)
        for row in rows:
            trie.add(row)
        for s, row in zip(sets, rows):
            assert sorted(trie.trace(row)) == [i for i, y in enumerate(sets) if near(s, y, percent)]
        links = ngram_join.trie_links(percent)([(i, row.tobytes()) for i, row in enumerate(rows)])
        assert set(links) <= {*want, *((b, a) for a, b in want)} and len(links) == len(rows) - len(set(classes_of(len(rows), want)))
        assert set(want) <= set(ngram_join.sketch_pairs(percent)([(0, i, i, len(row), ngram_join.sketch(row)) for i, row in enumerate(rows)]))


@pytest.mark.parametrize("blocks", [None, 9])
def test_join_of_families(spark, monkeypatch, blocks):
    """Families of copies with few words changed; with tiny blocks all routes of large groups are taken."""
    if blocks:
        monkeypatch.setattr(ngram_join, "BLOCK", blocks)
        monkeypatch.setattr(ngram_join, "LARGE_BLOCK", blocks)
    r = random.Random(2)
    words, rows = [f"w{i}" for i in range(400)], []
    for size, copies in ((5, 5), (40, 5), (150, 50), (300, 1), (150, 30), (60, 9), (300, 20)):
        base = [r.choice(words) for _ in range(size)]
        for _ in range(copies):
            x = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
                x[r.randrange(size)] = r.choice(words)
            rows.append((len(rows), " ".join(x)))
    rows += [(1000, None), (1001, ""), (None, "null id"), (None, None), (1002, "one"), (1003, "ONE"), (1004, "one two"), (3, rows[50][1]), (1005, rows[50][1])]
    df = spark.createDataFrame([(*x, "r", 1, 2, 3, 4, "c") for x in rows], WIDE_DOCS)
    got = ngram_join.with_components(df, small=3 if blocks else ngram_join.SMALL)
    assert sorted(map(tuple, got.collect()), key=str) == brute_join(rows)


def test_join_query(spark, sf):
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    assert sorted(map(tuple, QUERIES["op13_ngram_join"](spark, sf).collect()), key=str) == brute_join(list(zip(t["doc_id"], t["text"])))
    assert ngram_join.with_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
