"""SimHash, token shards, BPE, language ID, quality rules against brute force."""

import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from rippleline.llm import bpe, langid, quality, simhash, token_shards, wavelet
from rippleline.llm.common import stretches
from rippleline.llm.queries import QUERIES, vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, kept int, score string, fp string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_docs(spark):
    long_text = " ".join(random.Random(1).choice(["the", "of", "and,", "Thnt.", "über", "été"]) + str(i % 97) for i in range(60_000))
    texts = [None, "", "   \n\t ", "one", "one two", "One TWO three", "one two three", "a  b \n\n c", "<|endoftext|> x <|ENDOFTEXT|>, y", "it's, isn't. 'twas!!,.", "İstanbul ΣΑΣ, ﬁ é. é,", "x̸, ≮ a,̸ b.", "12 345 6,7.8", long_text, long_text]
    rows = [(i, t, "en", "s", 0, "x", 1, "y", "z") for i, t in enumerate(texts)] + [(3, "one", "en", "s", 0, "x", 1, "y", "z"), (3, "uno, dos", "es", "s", 0, "x", 1, "y", "z"), (None, "null id", None, None, 0, "x", 1, "y", "z"), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS), [(r[0], r[1]) for r in rows]


def sample(sf):
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return list(zip(t["doc_id"], t["text"]))


def brute_fingerprint(text):
    words = [w.translate({i: i + 32 for i in range(65, 91)}) for w in WORD.findall(text or "")]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """prints: [(doc_id, fingerprint)] -> component ids, by all pairs of distinct fingerprints."""
    distinct = sorted({f for _, f in prints})
    parent = {f: f for f in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    return [(d, f, least.get(root(f))) for d, f in prints]


def key(row):
    return tuple((x is None, x) for x in row)


def test_simhash_query(spark, sf):
    got = QUERIES["op3_simhash"](spark, sf).collect()
    want = brute_components([(d, brute_fingerprint(t)) for d, t in sample(sf)])
    assert sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got) == sorted(want)
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in got)


def test_simhash_odd(spark):
    df, rows = odd_docs(spark)
    small = [(d, t if not t or len(t) < 1000 else t[:1000]) for d, t in rows]
    df = spark.createDataFrame(small, "doc_id long, text string")
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.with_components(df).collect()]
    assert sorted(got, key=key) == sorted(brute_components([(d, brute_fingerprint(t)) for d, t in small]), key=key)
    assert simhash.with_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [2, 24])
def test_links_lose_no_link(spark, crowd):
    """Random prints around a few centres, so that block pairs are crowded; both routes give the same components."""
    r = random.Random(5)
    prints = {0, 1, 2**63, 2**64 - 1}
    for centre in [r.getrandbits(64) for _ in range(6)]:
        near = centre
        for _ in range(60):
            near = (centre if r.random() < 0.5 else near) ^ sum(1 << b for b in r.sample(range(64), r.choice([1, 2, 2, 3, 5])))
            prints.add(near)
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r.node % 2**64: r.root % 2**64 for r in simhash.components(simhash.links(df, crowd)).collect()}
    groups = {}
    for p in prints:
        groups.setdefault(roots.get(p, p), set()).add(p)
    want = {}
    for d, f, c in brute_components([(i, p) for i, p in enumerate(prints)]):
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    found = simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}}
    assert len(found) == 91
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_keep(rows):
    """rows: (doc_id, text, rest...). One row of each component of distinct fingerprints: least id, nulls last. Which of several with
    that id and other texts is free, but for their fingerprint."""
    prints = [brute_fingerprint(r[1]) for r in rows]
    roots = {f: c for _, f, c in brute_components([(i, f) for i, f in enumerate(prints)])}
    groups = {}
    for r, f in zip(rows, prints):
        groups.setdefault(roots[f], []).append(((r[0] is None, r[0] or 0, f - 2**64 if f >= 2**63 else f), r))
    return [[r for k, r in g if k == min(k for k, _ in g)] for g in groups.values()]


def test_deduplicate_keeps_one_of_each_component(spark):
    words = [f"w{i}" for i in range(400)]
    r = random.Random(9)
    base = [" ".join(r.choices(words, k=60)) for _ in range(12)]
    rows = [(i, base[i % 12], "s") for i in range(40)]
    rows += [(3, base[5], "t"), (3, "completely different words that nothing else here has", "t"), (4, "alpha beta gamma delta", "u"), (4, "alpha beta gamma delta", "u"), (4, "alpha beta gamma delta", "v")]
    rows += [(None, base[0], "n"), (None, "only nulls have this one", "n"), (None, "only nulls have this one", "n"), (None, None, None), (None, "", None), (7, "  ", "x"), (50, "no other has it", "y")]
    schema = "doc_id long, text string, _fp string"
    df = spark.createDataFrame(rows, schema).repartition(5).withColumn("_key", F.lit(1)).withColumn("key", F.lit(2)).withColumn("n", F.lit(3))
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    got = [tuple(x)[:3] for x in kept.collect()]
    want = brute_keep(rows)
    assert len(got) == len(want)
    for g in want:
        assert sum(x in g for x in got) == 1
    assert {"completely different words that nothing else here has", "no other has it"} <= {t for _, t, _ in got}
    assert sorted(map(str, got)) == sorted(str(tuple(x)[:3]) for x in simhash.deduplicate(df.repartition(3)).collect())
    assert simhash.deduplicate(df.limit(0)).count() == 0


def test_simhash_of_stretches():
    text = " ".join(random.Random(3).choices(["a", "Bc", "d\u00e9", "x" * 50, "\t"], k=4000))
    raw = text.encode()
    assert b"".join(simhash.stretches(raw, 100)) == raw and [w for s in simhash.stretches(raw, 100) for w in s.split()] == raw.split()
    want = brute_fingerprint(text)
    whole = simhash.stretches
    for size in (1, 7, 1000):
        simhash.stretches = lambda raw, size=size: whole(raw, size)
        try:
            assert simhash.simhash(text) == want and simhash.simhash("a b") == brute_fingerprint("a b")
        finally:
            simhash.stretches = whole


def test_token_shards_query(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want, start = [], 0
    for d, text in sorted(sample(sf)):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op2_token_shards"](spark, sf).collect())) == want


def test_token_shards_odd(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    df, rows = odd_docs(spark)
    more = ["a  b", "a \n b", "a\n  b", "x   ", "  lead", "a\t b\t\t c", "a  b  c", "\x1c a \x1c b", "é'll we're  'S", " " * 300 + "x"]
    rows = rows + [(100 + i, x) for i, x in enumerate(more)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = vocabulary("byte_bpe_50k.json")
    got = token_shards.read(token_shards.write(df, path, shard_tokens=700)).collect()
    want, start = [], 0
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]])):  # nulls come first
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((d, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in got), key=key) == sorted(want, key=key)
    assert token_shards.read(token_shards.write(df.limit(0), path)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 200_000])
def test_wavelet_lookups(n, tmp_path):
    r = np.random.default_rng(n)
    values = (r.zipf(1.3, n) % 50_000).astype(np.uint32)
    image = wavelet.build(values, [5, None], [n, 0], 16)
    w = wavelet.Wavelet.of(image)
    assert (w.tokens() == values).all() and w.n == n and w.doc_null.tolist() == [False, True]
    for i in r.integers(0, n, 12) if n else []:
        v = int(values[i])
        assert w.access(int(i)) == v
        assert w.count(v) == (values == v).sum()
        assert w.count(v, int(i)) == (values[:i] == v).sum()
        where = np.flatnonzero(values == v)
        assert w.select(v, len(where) - 1) == where[-1] and w.select(v, 0) == where[0]
    assert w.count(49_999) == (values == 49_999).sum() and w.count(1 << 20) == 0
    with pytest.raises(IndexError):
        w.select(65_000, 0)
    (tmp_path / "a.rlwm").write_bytes(image)
    with wavelet.Wavelet.open(str(tmp_path / "a.rlwm")) as f:
        taken, whole = [], f.read
        f.read = lambda offset, size: taken.append(size) or whole(offset, size)
        if n == 200_000:
            assert f.access(123_456) == values[123_456] and sum(taken) < len(image) / 2
        assert (f.tokens() == values).all() and f.doc_ids.tolist() == [5, 0]
    for v in {0, 1, 49_999, 1 << 20, *values[:5].tolist()}:
        assert w.occurrences(v) == np.flatnonzero(values == v).tolist()
    for i in (-1, n, n + 1, 1 << 40):
        with pytest.raises(IndexError):
            w.access(i)
    for end in (-1, n + 1):
        with pytest.raises(IndexError):
            w.count(1, end)


def test_token_files_by_path(spark, sf, tmp_path):
    """Files can be opened by the paths of the manifest, and hold what the documents say."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    some = sample(sf)[:40]
    made = token_shards.write(spark.createDataFrame(some, "doc_id long, text string"), vocabulary("byte_bpe_50k.json"), shard_tokens=3000, out=f"file://{tmp_path}/shards").orderBy("part", "k").collect()
    assert sorted(p.name for p in (tmp_path / "shards").iterdir()) == sorted(r.path.rpartition("/")[2] for r in made)
    at = 0
    for r in made:
        with wavelet.Wavelet.open(r.path) as w:
            ids = [i for d in w.doc_ids for i in [*t.encode(dict(some)[d] or "", add_special_tokens=False).ids, 0]]
            assert w.n == r.tokens == len(ids) and w.access(len(ids) // 2) == ids[len(ids) // 2] and w.count(0) == len(w.doc_ids) == ids.count(0)
            assert w.select(ids[5], 0) == ids.index(ids[5])
        at += len(ids)
    assert at == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in some)


def test_long_texts_in_portions():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    texts = [" ".join(random.Random(i).choices(["ab", "Cd9", "x,", "  ", "\n", "it's", "\u00e9t\u00e9", "<|endoftext|>", "7"], k=500)) for i in range(20)]
    e = token_shards.Encoder(open(path, encoding="utf-8").read(), "<u2")
    t = Tokenizer.from_file(path)
    for x in texts:
        assert np.frombuffer(e._encode_long(x, 20), "<u2").tolist() == t.encode(x, add_special_tokens=False).ids


@functools.cache
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def brute_bpe(text):
    t = library()
    ids = t.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("hot", [bpe.HOT_WORDS, 40, 0])
def test_bpe(spark, sf, hot):
    path = vocabulary("word_bpe_49k.json")
    df, rows = odd_docs(spark)
    rows = rows + [(1000 + d, t) for d, t in sample(sf)[:60]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = bpe.digest(df, path, hot).collect()
    assert sorted(map(tuple, got), key=key) == sorted(((d, *brute_bpe(t)) for d, t in rows), key=key)
    assert bpe.digest(df.limit(0), path, hot).count() == 0


@pytest.mark.parametrize("most,want", [(3, 0), (50, 50), (60, 60), (64, 60), (1000, 1000)])
def test_hot_words_are_never_more(spark, most, want):
    """Fifty words of the same very high count, ten of a lower one, others rare: a bin is taken whole or not at all."""
    rows = [(f"a{i}", 200_000) for i in range(50)] + [(f"b{i}", 150_000) for i in range(10)] + [(f"c{i}", 1 + i % 7) for i in range(940)]
    words = spark.createDataFrame(rows, "word string, n long")
    hot, rare = bpe.hot_and_rare(words, most)
    got = {r.word for r in hot.collect()}
    assert len(got) == want and len(got) <= most and rare.count() == 1000 - want
    assert all(n >= max([m for w, m in rows if w not in got], default=0) for w, n in rows if w in got)


def test_bpe_of_many_copies(spark):
    """A row a thousand times over, all its words rare: each place is listed once, and each row has its result."""
    path = vocabulary("word_bpe_49k.json")
    text = " ".join(f"qz{i}x" for i in range(300))
    df = spark.createDataFrame([(7, text)] * 1000 + [(8, text), (None, text)], "doc_id long, text string").repartition(4)
    got = bpe.digest(df, path, 0).groupBy("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").count().collect()
    assert sorted((tuple(r) for r in got), key=key) == sorted(((d, *brute_bpe(text), n) for d, n in ((7, 1000), (8, 1), (None, 1))), key=key)


def test_bpe_query(spark, sf):
    assert sorted(map(tuple, QUERIES["op9_bpe"](spark, sf).collect())) == sorted((d, *brute_bpe(t)) for d, t in sample(sf))


def test_language_query(spark, sf):
    got = QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").collect()
    truth = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "lang"]).to_pydict()
    lang = dict(zip(truth["doc_id"], truth["lang"]))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 150 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def brute_ranks(text):
    return [g for g, _ in sorted(brute_counts(text).items(), key=lambda x: (-x[1], x[0]))[:300]]


def brute_counts(text):
    from collections import Counter

    s = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    s = re.sub(" +", " ", s)
    c = Counter()
    for n in (1, 2, 3):
        for i in range(len(s) - n + 1):
            g = s[i : i + n]
            if g.strip() and (n < 3 or g[1] != " "):
                c[sum(ord(x) << 21 * (n - 1 - k) for k, x in enumerate(g))] += 1
    return c


def test_language_ranks_and_odd(spark, sf):
    for _, t in sample(sf)[:20]:
        assert langid.ranked(t, 300).tolist() == brute_ranks(t)
    df, rows = odd_docs(spark)
    got = langid.identify(df.withColumn("lang_pred", F.lit(1))).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[0].lang_pred == by[2].lang_pred == by[12].lang_pred == "und" and by[0].score == 0
    assert langid.identify(df.limit(0)).count() == 0
    none = langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def brute_language(docs):
    """docs: (doc_id, text, lang) -> {doc_id: (language, score)}, by dictionaries."""
    from collections import Counter

    sums = {}
    for d, t, lang in docs:
        if lang is not None and t is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            sums.setdefault(lang, Counter()).update(brute_counts(t))
    profiles = {lang: {g: i for i, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:300])} for lang, c in sorted(sums.items())}
    out = {}
    for d, t, _ in docs:
        mine = brute_ranks(t or "")
        far = {lang: sum(min(abs(p[g] - i), 300) if g in p else 300 for i, g in enumerate(mine)) for lang, p in profiles.items()}
        best = min(far, key=far.get)
        out[d] = (best, 1 - far[best] / (300 * len(mine))) if mine else ("und", 0.0)
    return out


def test_language_against_brute_force(spark, sf):
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pydict()
    want = brute_language(list(zip(t["doc_id"], t["text"], t["lang"])))
    got = {r.doc_id: (r.lang_pred, r.score) for r in QUERIES["op4_language_id"](spark, sf).collect()}
    assert {d: x for d, (x, _) in got.items()} == {d: x for d, (x, _) in want.items()}
    assert all(abs(got[d][1] - s) < 1e-12 for d, (_, s) in want.items())


def test_language_of_stretches(monkeypatch):
    text = "\u039f\u03b4\u03c5\u03c3\u03c3\u03b5\u03a5\u03a3 the cat\n\nsat on caf\u00e9 12 mats, \u0130stanbul! " * 40
    want = brute_ranks(text)
    for size in (1, 30, 1 << 18):
        monkeypatch.setattr(langid, "stretches", lambda t, _, size=size: stretches(t, size))
        assert langid.ranked(text, 300).tolist() == want


def brute_verdicts(docs):
    """docs: (doc_id, text, lang) -> {doc_id: kept}, by dictionaries and the formula of the distance."""
    from collections import Counter

    fixed = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\x0b\x0c\r", ".,;:!?'\"-()", "#*$%&|<>"]
    of = {c: i for i, x in enumerate(fixed) for c in x}

    def chars(t):
        c = Counter(of.get(x, 6 if ord(x) < 128 else 7) for x in t)
        return [c[i] for i in range(8)]

    def words(t):
        return Counter(re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[.,;:!?\"'()]", " ", t.lower())))

    def distance(p, q):
        p, q = [x / sum(p) if sum(p) else 0 for x in p], [x / sum(q) for x in q]
        m = [(a + b) / 2 for a, b in zip(p, q)]
        d = sum(a * np.log2(a / c) for a, c in zip(p, m) if a) + sum(b * np.log2(b / c) for b, c in zip(q, m) if b)
        return max(d / 2, 0) ** 0.5

    refs = {}
    for _, t, lang in docs:
        if lang is not None and t is not None:
            c, w = refs.setdefault(lang, ([0] * 8, Counter()))
            refs[lang] = [a + b for a, b in zip(c, chars(t))], w + words(t)
    places = {lang: [x for x, _ in sorted(w.items(), key=lambda y: (-y[1], y[0]))[: quality.COMMON]] for lang, (_, w) in refs.items()}
    out = {}
    for d, t, _ in docs:
        n, _, _, _, again = brute_quality(t)
        kept = n >= 50 and 2 * again <= n
        if kept and len(t) >= quality.MIN_CHARS:
            loose, w, kept = quality.SLACK / n**0.5, words(t), False
            for lang, (c, all_words) in refs.items():
                here = [w[x] for x in places[lang]]
                there = [all_words[x] for x in places[lang]]
                near = distance([*here, sum(w.values()) - sum(here)], [*there, sum(all_words.values()) - sum(there)])
                kept |= distance(chars(t), c) <= quality.MAX_CHARS + loose and near <= quality.MAX_WORDS + loose
        out[d] = kept
    return out


def test_quality_verdicts_against_brute_force(spark, sf):
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pydict()
    got = {r.doc_id: r.kept for r in QUERIES["op10_quality"](spark, sf).collect()}
    assert got == brute_verdicts(list(zip(t["doc_id"], t["text"], t["lang"]))) and len(set(got.values())) == 2


def test_clashing_names(spark):
    rows = [(i, " ".join(f"the cat{j} sat on{j * 7 % 31}" for j in range(30)) + f" {i}", "en") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("_found", F.col("doc_id") + 100).withColumn("_FOUND_", F.lit("y"))
    for made in (langid.predict(df, langid.fit(df)), quality.assess(df), langid.keep_identified(df), quality.keep_good(df)):
        assert made.columns[:5] == df.columns and {(r.doc_id, r._found, r["_FOUND_"]) for r in made.collect()} == {(i, i + 100, "y") for i in range(8)}


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    from collections import Counter

    c = Counter(zip(w, w[1:], w[2:]))
    cover = {i + k for i in range(len(w) - 2) if c[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_quality(spark, sf):
    got = QUERIES["op10_quality"](spark, "/root/testdata/sf0.01").collect()
    want = {d: brute_quality(t) for d, t in sample("/root/testdata/sf0.01")}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    labels = pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pydict()
    good = {d for d, q in zip(labels["doc_id"], labels["quality"]) if q == 1}
    bad = set(labels["doc_id"]) - good
    ok = {r.doc_id for r in got if r.kept}
    fair = {r.doc_id for r in got if not r.base_failed}
    assert len(ok & good) >= 0.995 * len(good & fair)
    assert len(ok & bad) <= 0.1 * len(bad)


def test_quality_odd(spark):
    df, rows = odd_docs(spark)
    got = quality.assess(df).collect()
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted(brute_quality(t) for _, t in rows)
    assert quality.assess(df.limit(0)).count() == 0
    assert quality.js_distance(np.array([1.0, 0]), np.array([0.0, 1])) == pytest.approx(1) and quality.js_distance(np.array([2.0, 2]), np.array([1.0, 1])) == 0


def test_quality_references_are_sums_over_all(spark):
    rows = [(i, "The cat, the dog. THE end\n" * (i + 1), "en" if i % 2 else None) for i in range(30)]
    refs = quality.references(spark.createDataFrame(rows, "doc_id long, text string, lang string"), common=2)
    n = sum(i + 1 for i in range(30) if i % 2)
    chars, place, sums = refs["en"]
    assert place == {"the": 0, "cat": 1} and sums.tolist() == [3 * n, n, 2 * n]
    assert chars.tolist() == quality.classes(("The cat, the dog. THE end\n" * n).encode()).tolist()
