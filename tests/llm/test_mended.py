"""Faults that were found, each with a test: texts of one id that share a hash, repeated rows in a sample, names in another case."""

import hashlib
import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rippleline.llm import bpe, langid, mixing, quality, toxicity
from rippleline.llm.queries import vocabulary


@pytest.fixture(scope="module")
def tokenizer():
    import tokenizers

    t = tokenizers.Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    return t


def wanted(tokenizer, rows):
    out = []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        out.append((doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return Counter(out)


def digests(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return Counter(map(tuple, bpe.digest(df, vocabulary("word_bpe_49k.json"), hot_words=1).collect()))


def test_two_texts_of_one_id_that_shared_a_short_hash(spark, tokenizer):
    rows = [(7, "zq16021x rare706091647 rare589247632"), (7, "zq30183x rare646520588"), (None, "zq16021x rare706091647 rare589247632"), (None, "zq30183x rare646520588")]
    assert digests(spark, rows) == wanted(tokenizer, rows)


@pytest.mark.parametrize("bits", [0, 1])
def test_texts_whose_tags_are_equal(spark, tokenizer, monkeypatch, bits):
    """Every tag is the same, or one of two: documents are still told apart, repeated rows and null ids too."""
    monkeypatch.setattr(bpe, "tag", lambda text: (F.length(text) % 2 * 4 * bits).cast("int"))
    r = random.Random(bits)
    rows = [(r.choice([1, 2, 3, None]), r.choice([None, "", *(" ".join(f"w{r.randrange(40)}q{r.randrange(9)}" for _ in range(r.randrange(1, 30))) for _ in range(30))])) for _ in range(80)]
    rows += rows[:20]
    assert digests(spark, rows) == wanted(tokenizer, rows)


def test_a_repeated_id_does_not_fill_the_sample(spark):
    """20,000 rows of one id: the few of them that are learned don't lead the profile. A row that is repeated is learned once."""
    texts = [("xyz" * (1 + i % 3) + str(i), 5) for i in range(20_000)] + [(f"plain english words number {i}", 100 + i) for i in range(300)]
    docs = spark.createDataFrame([(d, t, "en") for t, d in texts], "doc_id long, text string, lang string")
    profile, alone = (langid.fit(d, fit_docs=640)["en"].tolist() for d in (docs, docs.where("doc_id >= 100")))
    assert len(set(profile[:3]) & set(alone[:12])) >= 2
    once, often = (langid.fit(spark.createDataFrame([(1, "abc abd", "en")] * n + [(3, "zzz zzz zzz", "en")], docs.schema))["en"].tolist() for n in (1, 50))
    assert once == often


NAMES = "doc_id long, text string, lang string, source string, Score string, KEPT int, Size string, P_Toxic string, Lang_Pred int, N_Words int, Copies int"


def named(spark):
    words = [["the", "cat", "sat", "on", "a", "mat"], ["der", "hund", "lief", "durch", "den", "wald"]]
    r = random.Random(1)
    return spark.createDataFrame([(i, " ".join(r.choice(words[i % 2]) + (str(r.randrange(30)) if r.random() < 0.2 else "") for _ in range(90)), ["en", "de"][i % 2], "s", f"own{i}", 3, "mine", "p", 1, 2, 4) for i in range(40)], NAMES)


def test_columns_named_as_results_in_another_case(spark, tmp_path):
    docs = named(spark)
    labels = spark.createDataFrame([(i, i % 3 > 0, i % 2) for i in range(40)], "doc_id long, quality boolean, toxic int").withColumn("quality", F.col("quality").cast("int"))
    results = {
        "langid": langid.predict(docs, langid.fit(docs)), "mixing": mixing.mix(docs), "quality": quality.assess(docs), "toxicity": toxicity.predict(docs, toxicity.fit(docs.select("doc_id", "text"), labels)),
    }
    for name, df in results.items():
        df.write.parquet(str(tmp_path / name))
        assert len({c.lower() for c in df.columns}) == len(df.columns)
        assert spark.read.parquet(str(tmp_path / name)).count() == 40


def test_filters_give_back_the_columns_they_were_given(spark):
    docs = named(spark)
    for kept in (langid.keep_identified(docs), quality.keep_good(docs)):
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert rows and all(x.Score == f"own{x.doc_id}" and (x.KEPT, x.Size, x.P_Toxic, x.Lang_Pred, x.N_Words) == (3, "mine", "p", 1, 2) for x in rows)
    assert list(itertools.chain(quality.keep_good(docs.limit(0)).collect(), langid.keep_identified(docs.limit(0)).collect())) == []
