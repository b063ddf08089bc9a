"""Mixing, WARC, chat, toxicity, neighbours and the pipeline."""

import base64
import codecs
import email.parser
import email.policy
import gzip
import hashlib
import html.parser
import io
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F

from rippleline.llm import ann, chat, mixing, toxicity, warc
from rippleline.llm.common import row_key
from rippleline.llm.queries import ORACLE_SQL, QUERIES


def oracle(name, sf):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con.sql(ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf, name):
    want = oracle(name, sf)
    got = QUERIES[name](spark, sf).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def brute_targets(sizes, weights=(5, 2, 1)):
    """Share by weight, stop at the cap, reshare the excess, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > 3 * sizes[s]}
        if not over:
            target.update({s: left * w[s] / total for s in open_})
            break
        target.update({s: 3.0 * sizes[s] for s in over})
        left -= sum(3.0 * sizes[s] for s in over)
        open_ -= over
    return target


def test_mix_targets_and_taken(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 40, 300])), r.choice(["a"] * 40 + ["b"] * 20 + ["c", "d", None, "Ω", "zero"])) for i in range(3000)]
    rows = [(i, None if s == "zero" else t, s) for i, t, s in rows] + [(7, "w w", "a")] * 3 + [(None, "w", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("taken", F.lit("x")).withColumn("size", F.lit(1))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    taken = {}
    for x in got:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(want[x.source])
        assert 0 <= x.taken <= 3 * x.size
        taken[x.source] = taken.get(x.source, 0) + x.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 700
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted((x.doc_id or -1, x.size, x.taken) for x in got) == sorted((x.doc_id or -1, x.size, x.taken) for x in again)
    assert mixing.mix(df.limit(0)).count() == 0


def test_sample_keeps_columns_and_copies(spark):
    r = random.Random(6)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 40])), r.choice("aaaab"), 10 * i, "c", 1.5) for i in range(400)]
    rows += [(7, "w w", "a", 1, "c", 2.0), (7, "v v", "a", 1, "c", 2.0), (7, "v v", "b", 1, "c", 2.0), (None, None, None, None, None, None)] + [(9, "x y z", "b", 5, "r", 0.0)] * 2500
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, _copy string, copies double").repartition(3)
    out = mixing.sample(df)
    assert out.columns == df.columns
    got = [tuple(x) for x in out.collect()]
    assert set(got) <= set(rows)
    mixed = mixing.mix(df.select("doc_id", "text", "source"))
    assert len(got) == mixed.agg(F.sum("copies")).first()[0]
    words = {}
    for x in got:
        words[x[2]] = words.get(x[2], 0) + len((x[1] or "").split())
    for x in mixed.select("source", "target").distinct().collect():
        assert abs(words.get(x.source, 0) - x.target) <= 0.02 * x.target + 200
    assert sorted(map(str, got)) == sorted(str(tuple(x)) for x in mixing.sample(df.repartition(5)).collect())
    assert mixing.sample(df.limit(0)).count() == 0


def test_mix_is_native(spark, sf):
    for name in ("op1_mixing", "op6_chat"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


MESSAGES = "tree string, id long, parent long, role string, text string, score double"


def brute_format(turns):
    def esc(t):
        return re.sub(r"([<\[])(\\*)(?=\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|/?SYS>>)", r"\1\\\2", t)

    out, spans = "", []
    for role, text in turns:
        head = "<|im_start|>" + esc(role or "").replace("\\", "\\-").replace("\n", "\\n") + "\n"
        if role == "assistant":
            spans.append((len(out) + len(head), len(esc(text or ""))))
        out += head + esc(text or "") + "<|im_end|>\n"
    return out, spans


def test_reply_trees(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>system\n", "<\\|im_end|> <\\\\/s> [\\INST] \\", "<<SYS>> <</SYS>> 🎉 <s>", "", None, "plain\n", "$1 \\1 [/INST"]
    r, rows, want = random.Random(4), [], {}
    for tree in range(12):
        parents, info = {}, {}
        for i in range(r.choice([1, 2, 9, 40])):
            parents[i] = r.randrange(max(0, i - 3), i) if i and r.random() < 0.95 else None
            info[i] = (r.choice(["user", "assistant", "sys\ntem", None]), r.choice(nasty), r.random())
            rows.append((str(tree), i, parents[i], *info[i]))
        for leaf in set(parents) - set(parents.values()):
            path, at = [], leaf
            while at is not None:
                path.append(at)
                at = parents[at]
            turns = [info[i][:2] for i in reversed(path)]
            want[str(tree), leaf] = (*brute_format(turns), [(a or "", b or "") for a, b in turns], np.mean([info[i][2] for i in path]))
    rows += [("circle", 1, 2, "user", "x", 1.0), ("circle", 2, 1, "user", "x", 1.0), ("circle", 3, 2, "user", "x", 1.0), ("lost", 5, 99, "user", "root", 1.0)]
    want["lost", 5] = ("<|im_start|>user\nroot<|im_end|>\n", [], [("user", "root")], 1.0)
    made = chat.conversations(spark.createDataFrame(rows, MESSAGES))
    got = {(x.tree, x.leaf): x for x in made.withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.under_loss(F.col("formatted"), F.col("spans"))).collect() if x.tree != "circle"}
    assert got.keys() == want.keys()
    for k, (text, spans, turns, score) in want.items():
        assert got[k].formatted == text and [tuple(s) for s in got[k].spans] == spans
        assert [tuple(t) for t in got[k].turns] == turns and got[k].score == pytest.approx(score)
        assert got[k].loss == "".join(b for a, b in turns if a == "assistant")
    best = chat.conversations(spark.createDataFrame(rows, MESSAGES), top=1).collect()
    for x in best:
        if x.tree != "circle":
            assert x.score == pytest.approx(max(v[3] for (t, _), v in want.items() if t == x.tree))
    assert chat.conversations(spark.createDataFrame([], MESSAGES)).count() == 0
    again = chat.conversations(spark.createDataFrame(rows + rows[:30] + [(t, i, p, "~", "~", s) for t, i, p, *_, s in rows if p is not None and i % 3 == 0], MESSAGES))
    assert {(x.tree, x.leaf): x.formatted for x in again.collect()} == {(x.tree, x.leaf): x.formatted for x in made.collect()}


def test_branches_are_ranked(spark):
    rows = [("t", 0, None, "user", "q", 0.0), ("t", 1, 0, "assistant", "a", 1.0), ("t", 2, 0, "assistant", "b", 3.0), ("t", 3, 0, "assistant", "c", 3.0), ("t", 4, 1, "user", "d", 9.0), ("t", 3, 0, "assistant", "c", 3.0)]
    got = {x.leaf: (x.rank, x.score) for x in chat.conversations(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert got == {4: (1, pytest.approx(10 / 3)), 2: (2, 1.5), 3: (3, 1.5)}
    assert {x.leaf for x in chat.conversations(spark.createDataFrame(rows, MESSAGES), top=2).collect()} == {4, 2}


def test_chat_odd_rows(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", None), (5, 1, "assistant", "b"), (5, 1, "assistant", "b"), (5, 0, None, "c"), (6, 0, "assistant", "x" * 50_000)]
    got = {x.conv_id: x for x in chat.digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[None].turns_sha256 == sha("user\na\nassistant\n\n") and got[None].loss_chars == 0
    assert got[5].n_turns == 3 and got[5].turns_sha256 == sha("\nc\nassistant\nb\nassistant\nb\n") and got[5].loss_sha256 == sha("bb")
    assert got[6].loss_chars == 50_000


def test_warc_records(spark, sf):
    pages = pq.read_table(f"{sf}/pages.parquet").to_pylist()
    odd = [dict(page_id=-1, url=None, html=None), dict(page_id=None, url="http://a/\r\nX: y", html=""), dict(page_id=-2, url="http://b", html="<p>a<script>x</p>"), dict(page_id=-2, url="http://b", html="<p>a<script>x</p>")]
    df = spark.createDataFrame([(p["page_id"], p["url"], p["html"], 1) for p in pages + odd], "page_id long, url string, html string, kind int")
    got = warc.derivatives(df).collect()
    assert len(got) == 2 * len(pages + odd)
    ids = set()
    for x in got:
        headers, body = warc.parse(bytes(x.record))
        assert headers["warc-type"] == x.kind and headers["warc-refers-to"] == x.refers_to and len(body) == x.content_length
        assert x.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        ids.add(x.record_id)
    assert len(ids) == 2 * (len(pages + odd) - 1)
    by = {p["page_id"]: p for p in pages}
    for x in got:
        if x.page_id in by:
            p = by[x.page_id]
            record = warc.response(p["page_id"], p["url"], p["html"])
            headers, block = warc.parse(record)
            assert x.refers_to == headers["warc-record-id"] and x.target_uri == p["url"]
            assert x.source_digest == headers["warc-payload-digest"] == warc.digest(p["html"].encode())
            assert block.endswith(p["html"].encode())
    assert warc.derivatives(df.limit(0)).count() == 0


class Walk(html.parser.HTMLParser):
    """Plain text, title, language and links by the standard parser's events."""

    HIDDEN = {"script", "style", "template", "noscript"}
    BLOCKS = set("address article aside blockquote br dd div dl dt footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th title tr ul head body html".split())

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden, self.inside, self.name, self.lang, self.links = [], 0, False, "", "", []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        self.hidden += tag in self.HIDDEN
        self.inside |= tag == "title"
        if tag in self.BLOCKS:
            self.out.append("\n")
        if tag == "html" and a.get("lang"):
            self.lang = a["lang"].lower()
        if tag == "a" and a.get("href") is not None and not self.hidden:
            self.links.append(a["href"])

    def handle_endtag(self, tag):
        self.hidden -= tag in self.HIDDEN
        self.inside &= tag != "title"
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)
            self.name += data if self.inside else ""

    def text(self):
        return "\n".join(x for x in (" ".join(y.split()) for y in "".join(self.out).split("\n")) if x)


def second_parser(raw):
    """A record by the standard library's parser of headers."""
    version, _, rest = raw.partition(b"\r\n")
    head, _, body = rest.partition(b"\r\n\r\n")
    fields = email.parser.BytesParser(policy=email.policy.HTTP).parsebytes(head + b"\r\n\r\n")
    assert version == b"WARC/1.1" and body[int(fields["Content-Length"]) :] == b"\r\n\r\n"
    return {k: str(v) for k, v in fields.items()}, body[: int(fields["Content-Length"])]


def test_warc_against_second_parser(spark, tmp_path):
    """Files that gzip opens; headers, text, title, links by other parsers than the operator's."""
    sf = "/root/testdata/sf0.01"
    made = warc.write(spark.read.parquet(f"{sf}/pages.parquet").repartition(3), out=f"file://{tmp_path}/warc", shard_bytes=20_000)
    files = {r.path.removeprefix("file://"): r.records for r in made.collect()}
    assert len(files) > 3 and {str(p) for p in (tmp_path / "warc").iterdir()} == set(files)
    pages = {p["page_id"]: p for p in pq.read_table(f"{sf}/pages.parquet").to_pylist()}
    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    seen, refers = Counter(), {}
    for path, n in files.items():
        with open(path, "rb") as f:
            records = list(members(f.read()))
        assert b"".join(records) == gzip.open(path).read() and len(records) == n
        for raw in records:
            h, body = second_parser(raw)
            p = pages[int(h["X-Row-ID"])]
            walk = Walk(p["html"])
            assert h["WARC-Target-URI"] == p["url"] and h["WARC-Block-Digest"] == sha1(body) and h["WARC-Source-Payload-Digest"] == sha1(p["html"].encode())
            if h["WARC-Type"] == "conversion":
                assert h["Content-Type"].startswith("text/plain") and body.decode() == walk.text()
            else:
                facts = [tuple(x.split(": ", 1)) for x in body.decode().split("\r\n")[:-1]]
                assert h["Content-Type"] == "application/warc-fields" and ("title", " ".join(walk.name.split())) in facts and ("language", walk.lang) in facts
                assert [v for k, v in facts if k == "outlink"] == walk.links
                assert ("http-header", f"Content-Length: {len(p['html'].encode())}") in facts
            seen[p["page_id"], h["WARC-Type"]] += 1
            refers.setdefault(p["page_id"], set()).add(h["WARC-Refers-To"])
    assert seen == {(i, k): 1 for i in pages for k in ("conversion", "metadata")} and all(len(x) == 1 for x in refers.values())
    assert {(r.page_id, r.kind): r.record_id for r in warc.read(made).collect()}.keys() == seen.keys()
    whole = warc.member(warc.response(1, "http://x", "<p>x" * 1000))
    for cut in (whole[:-12], gzip.compress(gzip.decompress(whole)[:-100])):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(cut).read))


def members(data):
    """The gzip members of a file."""
    while data:
        unpack = zlib.decompressobj(31)
        yield unpack.decompress(data)
        assert unpack.eof
        data = unpack.unused_data


def foreign(http, body, *fields, version="WARC/1.0", kind="response", content="application/http; msgtype=response"):
    """A record as other crawlers write it."""
    block = http + b"\r\n\r\n" + body if http is not None else body
    head = [version, f"WARC-Type: {kind}", "warc-record-id: <urn:uuid:1>", "WARC-Date: 2020-01-02T03:04:05Z", *fields, f"content-length: {len(block)}", f"Content-Type: {content}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def chunked(data, size=7):
    parts = [data[i : i + size] for i in range(0, len(data), size)]
    return b"".join(b"%x;a=b\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\nX-Trailer: y\r\n\r\n"


def raw_deflate(data):
    pack = zlib.compressobj(wbits=-15)
    return pack.compress(data) + pack.flush()


CAFE = "<title>Café</title><p>naïve “x” €"
OK = b"HTTP/1.1 200 OK\r\n"
UTF, MARKED = CAFE.encode(), f'<meta http-equiv="x" content="text/html; charset=windows-1251">{"Привет"}'


@pytest.mark.parametrize(
    ("http", "body", "text", "charset"),
    [
        (OK + b"Content-Type: text/html; charset=ISO-8859-1", CAFE.encode("cp1252"), "Café\nnaïve “x” €", "windows-1252"),
        (OK + b'content-type: text/html;\r\n  Charset="latin1"', CAFE.encode("cp1252"), "Café\nnaïve “x” €", "windows-1252"),
        (OK + b"Content-Type: text/html", UTF, "Café\nnaïve “x” €", "utf-8"),
        (OK + b"Content-Type: text/html; charset=nonsense", UTF, "Café\nnaïve “x” €", "utf-8"),
        (OK + b"Content-Type: text/html; charset=hex", UTF, "Café\nnaïve “x” €", "utf-8"),
        (OK + b"Content-Type: text/html; charset=idna", UTF, "Café\nnaïve “x” €", "utf-8"),
        (OK + b"X: y", MARKED.encode("cp1251"), "Привет", "windows-1251"),
        (OK + b"Content-Type: text/html; charset=ascii", codecs.BOM_UTF16_LE + CAFE.encode("utf-16-le"), "Café\nnaïve “x” €", "utf-16-le"),
        (OK + b"Content-Type: text/html; charset=shift_jis", "<p>日本".encode("shift_jis"), "日本", "shift_jis"),
        (OK + b"Content-Encoding: gzip", gzip.compress(UTF), "Café\nnaïve “x” €", "utf-8"),
        (OK + b"Content-Encoding: GZIP", gzip.compress(UTF[:9]) + gzip.compress(UTF[9:]), "Café\nnaïve “x” €", "utf-8"),
        (OK + b"Content-Encoding: gzip", UTF, "Café\nnaïve “x” €", "utf-8"),
        (OK + b"Content-Encoding: deflate", zlib.compress(UTF), "Café\nnaïve “x” €", "utf-8"),
        (OK + b"Content-Encoding: deflate", raw_deflate(UTF), "Café\nnaïve “x” €", "utf-8"),
        (OK + b"Content-Encoding: zstd", zstandard.compress(UTF), "Café\nnaïve “x” €", "utf-8"),
        (OK + b"Content-Encoding: deflate\r\nContent-Encoding: gzip", gzip.compress(zlib.compress(UTF)), "Café\nnaïve “x” €", "utf-8"),
        (OK + b"Transfer-Encoding: chunked", chunked(UTF), "Café\nnaïve “x” €", "utf-8"),
        (OK + b"Transfer-Encoding: chunked", UTF, "Café\nnaïve “x” €", "utf-8"),
        (OK + b"Transfer-Encoding: chunked\r\nContent-Encoding: gzip", chunked(gzip.compress(UTF)), "Café\nnaïve “x” €", "utf-8"),
        (OK + b"Content-Encoding: br", b"\x8b\x02", "", ""),
        (OK + b"Content-Type: image/png", b"\x89PNG<p>x", "", ""),
        (OK + b"Content-Type: text/plain; charset=latin-1", b"a <b>\n\n  caf\xe9", "a <b>\n\n  café", "latin-1"),
        (OK + b"Content-Type: application/json", b'{"a": "<p>"}', '{"a": "<p>"}', "utf-8"),
        (OK + b"A: b", b"", "", "utf-8"),
    ],
)
def test_warc_payloads(http, body, text, charset):
    record = foreign(http, body)
    meta, conversion = warc.derive(record)
    about = [x.split(": ", 1) for x in second_parser(meta)[1].decode().split("\r\n")[:-1]]
    assert second_parser(conversion)[1].decode() == text
    assert ["charset", charset] in about and (["undecoded", "br"] in about) == (b"br" in http[-3:])
    said = email.parser.BytesParser(policy=email.policy.compat32).parsebytes(http.partition(b"\r\n")[2] + b"\r\n\r\n")
    assert [" ".join(v.split()) for k, v in about if k == "http-header"] == [" ".join(f"{k}: {v}".split()) for k, v in said.items()]
    if text.startswith("Café"):
        assert ["title", "Café"] in about


def test_warc_headers():
    given = ["WARC-IP-Address: 10.0.0.1", "WARC-Warcinfo-ID: <urn:uuid:9>", "WARC-Concurrent-To: <urn:uuid:7>", "WARC-Concurrent-To: <urn:uuid:8>", "WARC-Target-URI: http://a/é",
             "WARC-Payload-Digest: sha256:abc", "WARC-Block-Digest: md5:def", "WARC-Truncated: length", "X-Other: one\r\n two", "WARC-Segment-Number: 1"]
    for record in warc.derive(foreign(OK + b"A: b", b"<p>x", *given)):
        fields, _ = warc.read_record(record)
        conversion = warc.value(fields, "WARC-Type") == "conversion"
        source = "Source-" if conversion else ""
        assert [v for k, v in fields if k == f"WARC-{source}Concurrent-To"] == ["<urn:uuid:7>", "<urn:uuid:8>"] and warc.value(fields, f"WARC-{source}IP-Address") == "10.0.0.1"
        got = {k: v for k, v in fields}
        assert got["WARC-Refers-To"] == "<urn:uuid:1>" and got["WARC-Date"] == "2020-01-02T03:04:05Z" and got["WARC-Target-URI"] == "http://a/é" and got["WARC-Warcinfo-ID"] == "<urn:uuid:9>"
        assert got["WARC-Source-Payload-Digest"] == "sha256:abc" and got["WARC-Source-Block-Digest"] == "md5:def" and got["WARC-Source-Truncated"] == "length" and got["X-Other"] == "one two"
        assert not {"WARC-Segment-Number", "WARC-Payload-Digest", "WARC-Truncated"} & set(got) and len([k for k, _ in fields if k == "WARC-Block-Digest"]) == 1


def test_warc_files_of_a_crawl(spark, tmp_path):
    """Members of a record, of several and of parts of one; plain files; other kinds of record; names with signs."""
    ask = foreign(None, b"GET / HTTP/1.1\r\n\r\n", kind="request", content="application/http; msgtype=request")
    info = foreign(None, b"software: x\r\n", kind="warcinfo", content="application/warc-fields")
    dns = foreign(None, b"20200102\nx.org. 5 IN A 10.0.0.1\n", kind="response", content="text/dns")
    pages = [foreign(OK + b"Content-Type: text/html", f"<p>page {i} é{' w' * i * 50}".encode(), f"WARC-Target-URI: http://x/{i}") for i in range(40)]
    folder = tmp_path / "a crawl%20x"
    (folder / "below").mkdir(parents=True)
    (folder / "one.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in [info, ask, *pages[:10]]))
    (folder / "below" / "all.warc.gz").write_bytes(gzip.compress(b"".join(pages[10:20])))
    whole = b"".join(pages[20:30])
    (folder / "cut.warc.gz").write_bytes(b"".join(gzip.compress(whole[i : i + 777]) for i in range(0, len(whole), 777)))
    (folder / "plain.warc").write_bytes(b"".join([info, *pages[30:], ask, dns]))
    (folder / "empty.warc.gz").write_bytes(b"")
    files = warc.files_below(spark, str(folder))
    assert files.count() == 4 and list(warc.records(io.BytesIO().read)) == []  # Spark lists no empty files
    assert warc.read(files).count() == 40 + 5
    got = warc.read(warc.derive_files(files, f"{tmp_path}/out", 500)).collect()
    assert len(got) == 2 * 41 and all(x.refers_to == "<urn:uuid:1>" for x in got) and len(list((tmp_path / "out").iterdir())) > 10
    texts = {x.target_uri: second_parser(bytes(x.record) + b"\r\n\r\n")[1].decode() for x in got if x.kind == "conversion"}
    assert texts == {f"http://x/{i}": f"page {i} é{' w' * i * 50}" for i in range(40)} | {None: "20200102\nx.org. 5 IN A 10.0.0.1\n"}


def test_warc_text():
    page = '<html lang="EN"><head><title>A &amp; B</title><style>p{}</style></head><body><!-- no --><script>var a="</p>";</script><p>One<br>two <b>three</b>&lt;x&gt;<a href="/y?a=1&amp;b">l</a></body>'
    meta, text = warc.derive(warc.response(1, "http://x", page))
    assert warc.parse(text)[1].decode() == "A & B\nOne\ntwo three<x>l"
    about = warc.parse(meta)[1].decode()
    assert "title: A & B\r\n" in about and "language: en\r\n" in about and "outlink: /y?a=1&b\r\n" in about and "http-status: HTTP/1.1 200 OK\r\n" in about


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op7_toxicity"](spark, sf).withColumn("held", F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2")).collect()
    labels = pq.read_table(f"{sf}/labels.parquet").to_pydict()
    toxic = dict(zip(labels["doc_id"], labels["toxic"]))
    held = [(x.toxic_pred, toxic[x.doc_id]) for x in got if x.held and x.doc_id in toxic]
    hit = sum(p and t for p, t in held)
    assert hit >= 0.9 * sum(t for _, t in held) and hit >= 0.95 * sum(p for p, _ in held)


def test_toxicity_odd(spark):
    rows = [(i, None if i == 3 else "you idiot fool" if i % 3 == 0 else "kind words here", 1) for i in range(90)] + [(None, "idiot", 1), (200, "", 1), (4, "kind words here", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_toxic int")
    labels = spark.createDataFrame([(i, None if i == 7 else 1, int(i % 3 == 0 and i != 3)) for i in range(90)] + [(5, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(x.toxic_pred == (x.doc_id % 3 == 0 and x.doc_id != 3) for x in got if x.doc_id is not None and x.doc_id < 90)
    none = toxicity.classify(docs, labels.limit(0)).collect()
    assert {x.p_toxic for x in none} == {0.0}
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def plain_fit(rows, dense, y, size):
    """One document at a time, one weight at a time: what toxicity.Linear.fit computes in arrays."""
    n = len(rows)
    theta = [0.0] * (size + len(dense[0])) + [math.log((sum(y) + 1) / (n - sum(y) + 1))]
    m, v = [0.0] * len(theta), [0.0] * len(theta)
    for t in range(1, toxicity.ROUNDS + 1):
        g = [toxicity.L2 * x for x in theta[:-1]] + [0.0]
        for words, extra, label in zip(rows, dense, y):
            r = (plain_score(theta, words, extra, size) - label) / n
            for w in words:
                g[w] += r
            for i, x in enumerate(extra):
                g[size + i] += r * x
            g[-1] += r
        for i in range(len(theta)):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g[i], 0.99 * v[i] + 0.01 * g[i] ** 2
            theta[i] -= 0.1 * (m[i] / (1 - 0.9**t)) / (math.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    return theta


def plain_score(theta, words, extra, size):
    z = theta[-1] + sum(theta[w] for w in words) + sum(theta[size + i] * x for i, x in enumerate(extra))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_toxicity_chain_against_plain_loop():
    """The second model learns from out-of-fold predictions of the first; weights agree to 1e-9."""
    r, size, n = random.Random(1), 6, 40
    rows = [sorted(r.sample(range(size), r.randrange(0, 4))) for _ in range(n)]
    low = [int(0 in w or r.random() < 0.1) for w in rows]
    toxic = [int(a and 1 in w or r.random() < 0.05) for a, w in zip(low, rows)]
    fold = [r.randrange(toxicity.FOLDS) for _ in range(n)]
    doc = np.repeat(np.arange(n), [len(w) for w in rows])
    word = np.array([x for w in rows for x in w])
    models = toxicity.chain(doc, word, size, np.array([low, toxic]).T, np.array(fold))
    first = plain_fit(rows, [[]] * n, low, size)
    out = [0.0] * n
    for f in range(toxicity.FOLDS):
        inside = [i for i in range(n) if fold[i] != f]
        theta = plain_fit([rows[i] for i in inside], [[]] * len(inside), [low[i] for i in inside], size)
        for i in range(n):
            if fold[i] == f:
                out[i] = plain_score(theta, rows[i], [], size)
    second = plain_fit(rows, [[x] for x in out], toxic, size)
    for model, theta in zip(models, (first, second)):
        assert np.allclose(np.concatenate([model.w, model.dense, [model.bias]]), theta, rtol=0, atol=1e-9)


def test_toxicity_predicts_as_a_plain_loop(spark):
    """The query's words, fit and prediction on a small table, document by document."""
    rows = [(i, "you idiot fool, " * (i % 4) + "kind word " * (i % 3) + f"x{i % 5}yz") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_found", F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 > 1)) for i in range(80)], "doc_id long, quality int, toxic int")
    vocabulary, models = toxicity.fit(docs, labels)
    place = {w: i for i, w in enumerate(vocabulary)}
    got = toxicity.predict(docs, (vocabulary, models)).collect()
    assert vocabulary and "_found" in got[0].asDict()
    for x in got:
        words, extra = [place[w] for w in toxicity.features(x.text) if w in place], []
        for m in models:
            extra.append(plain_score([*m.w, *m.dense, m.bias], words, extra, len(vocabulary)))
        assert [x.p_low_quality, x.p_toxic] == pytest.approx(extra, abs=1e-9) and x.toxic_pred == (extra[1] >= 0.5)


def brute_distance(a, b):
    d = math.fsum((x - y) * (x - y) for x, y in zip(a, b))
    return math.sqrt(d) if 1e-280 < d < 1e300 else math.dist(a, b)


def brute_nearest(rows, k=10, dim=8):
    """rows: (vec_id, vector). A query's candidates are all distinct rows but itself."""
    fine = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for q, v in fine:
        if q % 100 == 0:
            d = sorted((brute_distance(v, w), i) for i, w in fine if (i, w) != (q, v))
            out += [(q, r + 1, i, x) for r, (x, i) in enumerate(d[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [1024, 16])
def test_neighbours_exact_when_all_is_visited(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    r = random.Random(3)
    near = [[r.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i * 25, [round(8 * (x + r.gauss(0, 0.2))) / 8 for x in r.choice(near)]) for i in range(160)]
    rows += [(10_000 + i, [1.0] * 8) for i in range(40)] + [(10_100, [1.0] * 8), (10_100, [1.0] * 8), (10_100, [1.0] * 7 + [1.5]), (10_200, [1.0] * 7 + [1.5])]
    rows += [(1, None), (100_000, [0.0] * 8), (2, [None] * 8), (3, [float("nan")] + [1.0] * 7), (4, [float("inf")] + [1.0] * 7), (5, [1.0] * 3), (None, [2.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = sorted(map(tuple, ann.search(df, F.col("vec_id") % 100 == 0, share=1.0).collect()))
    want = brute_nearest(rows)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], atol=1e-12)
    assert ann.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    few = ann.search(df.where("vec_id in (0, 25, 50)"), F.col("vec_id") % 100 == 0).collect()
    assert len(few) == 2


@pytest.mark.parametrize("dim", [1, 2])
def test_neighbours_in_double_precision(spark, dim):
    """Components that floats can't tell apart, that squares overflow with, and that they vanish with."""
    values = [0.1, 0.1 + 1e-9, 0.1 + 2e-9, 1e300, -1e300, 2e300, 1e-50, 3e-50, 1e-200, 2.5e-200, 1.0, 1e16, 1e16 + 2]
    rows = [(100 * i if i % 2 else i, [0.2] * (dim - 1) + [v]) for i, v in enumerate(values)] + [(700, [0.0] * (dim - 1) + [5e-201])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, ann.search(df, F.col("vec_id") % 100 == 0, k=4).collect()))
    want = brute_nearest(rows, 4, dim)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], rel=1e-12, abs=0)


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_neighbours_recall(spark, size):
    """The registered query, with its parameters, against all distances."""
    sf = f"/root/testdata/{size}"
    t = pq.read_table(f"{sf}/embeddings.parquet").to_pydict()
    x, ids = np.array(t["embedding"], np.float64), np.array(t["vec_id"])
    got = {}
    for row in QUERIES["op8_neighbours"](spark, sf).collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    hits = []
    for i in np.flatnonzero(ids % 100 == 0):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hits.append(len(got[ids[i]] & set(ids[np.argsort(d, kind="stable")[:10]])) / 10)
    assert np.mean(hits) >= 0.9 and all(len(v) == 10 for v in got.values())


def test_visits_go_by_summed_distance():
    r = np.random.default_rng(0)
    first, second, q = r.normal(size=(6, 2)), r.normal(size=(5, 2)), r.normal(size=4)
    got = ann.visits(q, first, second, {c: 1 for c in range(30)}, 30)
    d = ((first - q[:2]) ** 2).sum(1)[:, None] + ((second - q[2:]) ** 2).sum(1)[None]
    assert got == np.argsort(d.ravel(), kind="stable").tolist()
    assert len(ann.visits(q, first, second, {c: 1 for c in range(0, 30, 2)}, 4)) == 4


@pytest.mark.parametrize("seed", range(20))
def test_visits_over_many_tiles(seed):
    """Lists of many tiles, empty and crowded cells: the cells of all sums sorted, up to the one that makes it enough."""
    r = np.random.default_rng(seed)
    m, n = int(r.integers(1, 90)), int(r.integers(1, 90))
    first, second, q = r.normal(size=(m, 3)), r.normal(size=(n, 4)), r.normal(size=7)
    held = {int(c): int(r.integers(1, 50)) for c in r.choice(m * n, int(r.integers(1, m * n + 1)), replace=False)}
    enough = int(r.integers(1, sum(held.values()) + 20))
    d = (((first - q[:3]) ** 2).sum(1)[:, None] + ((second - q[3:]) ** 2).sum(1)[None]).ravel()
    want, total = [], 0
    for c in sorted(held, key=lambda c: d[c]):
        if total < enough:
            want.append(c)
            total += held[c]
    assert ann.visits(q, first, second, held, enough) == want == ann.visits(q, first, second, ann.counts(held, m * n), enough)


def test_pipeline_against_stages(spark, sf):
    import corpus_pipeline

    from test_text_operators import brute_bpe, brute_components, brute_fingerprint, brute_quality

    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "quality rules", "SimHash near-dedup", "mixing sources to target weights", "BPE encoding and decoding"]
    at, sizes = spark.read.parquet(f"{sf}/documents.parquet"), []
    columns = at.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = at.collect()
        at = stage(spark, at, sf)
        assert at.columns == columns
        after = at.collect()
        sizes.append((name, len(before), len(after)))
        have = {tuple(x) for x in before}
        assert {tuple(x) for x in after} <= have
        if name == "quality rules":
            fair = {x.doc_id for x in before if (q := brute_quality(x.text))[0] >= 50 and 2 * q[4] <= q[0]}
            assert {x.doc_id for x in after} <= fair and len(after) >= 0.9 * len(fair)
        if name == "SimHash near-dedup":
            found = brute_components([(x.doc_id, brute_fingerprint(x.text)) for x in before])
            assert sorted(x.doc_id for x in after) == sorted({c for _, _, c in found})
        if name == "mixing sources to target weights":
            df = spark.createDataFrame(before, at.schema)
            want = {x.doc_id: x.copies for x in mixing.mix(df, tie=row_key(df)["a"]).collect()}
            assert Counter(x.doc_id for x in after) == {d: n for d, n in want.items() if n} and max(want.values()) <= 3
        at = spark.createDataFrame(after, at.schema)
    want = sorted((x.doc_id, *brute_bpe(x.text)) for x in after)
    assert sorted(map(tuple, QUERIES["pipeline"](spark, sf).collect())) == want
    assert len(docs) >= sizes[0][2] >= sizes[1][2] >= sizes[2][2]
