"""N-gram Jaccard join: texts whose sets of word n-grams overlap enough, by tries of globally ordered sets.

Order. N-grams are 64-bit hashes, ordered by how often their bucket occurs in all documents (2^20 buckets, whatever the input's size), then by
hash: rare ones first, so the beginning of a set tells most. Texts with the same set are one class from the start.

Candidates. Two sets of sizes m <= n that are near enough share an n-gram among the first few of either (its size less the overlap that any partner
must have, plus one). Classes are filed under those. Of n-grams filed by exactly the same classes one is enough; such groups are told by their size and
two independent 64-bit sums over their members. A group of any size is dealt out: a small one is one block, a large one is cut into blocks by class.

- In a large group each class belongs to, say, one: its largest. There, block by block and with the group's least class in each, whole sets
  go into tries, which links the copies of one text without their pairs.
- Of all groups, members of different components whose sizes allow a link are compared by odd sketches: bit maps of the parity of
  hashed n-grams. They differ in no more bits than the sets do in n-grams, so no link is lost, and most others are ruled out.
- What is left are pairs across components. Partners of one class form a trie, which the class is traced through.

A trie holds sets in global order, runs of n-grams without a branch as one edge, and sizes of the sets below. Tracing a set goes down all
branches at once with the overlap so far, which sets with the same beginning share; a subtree is left when the overlap, plus what remains of the
set or of the longest below it, can't reach the least overlap asked for, when no size below it fits, or when all below is in the set's component.

Components come from alternating star contraction.

Edge cases: null and wordless texts have an empty set, are linked with nothing and are their own component; texts with fewer words than n have one n-gram,
their whole sequence; rows with null doc_id take part and their component is the smallest doc_id in it, null if it has none;
repeated rows and ties are one class; other columns, whatever their names, are not read; an empty table gives an empty result. Long texts are hashed a stretch at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleline.llm.common import bounded_batches, drop, materialize, release, released, stretches
from rippleline.llm.simhash import components

N, PERCENT = 3, 90
BUCKETS, CHUNK = 20, 1 << 12  # bits of the number of buckets; buckets a batch
SMALL, BLOCK, LARGE_BLOCK = 24, 192, 2048


def hashes(text: str | None, n: int = N) -> np.ndarray:
    """The distinct n-grams of a text as sorted 64-bit hashes. bytes.lower() and bytes.split() know ASCII only, as the contract asks."""
    found, words, digest = [], [], xxhash.xxh64_intdigest
    for raw in stretches((text or "").encode("utf-8", "surrogatepass")):
        words += raw.lower().split()
        if len(words) < n:
            continue
        length = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(length + 1) - 1
        joined, start, last = b" ".join(words), end - length, len(words) - n + 1
        found.append(np.unique(np.fromiter((digest(joined[i:j]) for i, j in zip(start[:last].tolist(), end[n - 1 :].tolist())), np.uint64, last)))
        words = words[last:]
    if not found:
        return np.array([digest(b" ".join(words))] if words else [], np.uint64)
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def least_overlap(m: int, n: int, percent: int = PERCENT) -> int:
    """What sets of these sizes must share: percent * (m + n) / (100 + percent), rounded up."""
    return -(-percent * (m + n) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """A set of n shares at least percent * n / 100 with a partner, so one of so many first n-grams."""
    return n - -(-percent * n // 100) + 1 if n else 0


def sketch(h: np.ndarray) -> bytes:
    """The parity of the n-grams that fall on each bit; as many bits as n-grams, to the next power of two."""
    bits = max(128, 1 << (len(h) - 1).bit_length()) if len(h) else 128
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _folded(raw: bytes, size: int) -> np.ndarray:
    """A sketch on fewer bits: parities of bits that now meet."""
    bits = np.frombuffer(raw, np.uint8)
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


class Node:
    """An edge of a trie with all that is below it."""

    __slots__ = ("run", "below", "least", "most", "ends", "component")

    def __init__(self, run: np.ndarray, size: int, ends: list[int], component: int | None):
        self.run, self.below, self.least, self.most, self.ends, self.component = run, {}, size, size, ends, component


class Trie:
    """Sets in one order, and the components that links between them make."""

    def __init__(self, percent: int = PERCENT):
        self.percent, self.root, self.parent, self.rows = percent, Node(np.zeros(0, np.uint64), 1 << 62, [], -1), [], []
        self.root.most = 0

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def add(self, row: np.ndarray, place: int | None = None) -> int:
        """Put a set in; its place, which is also its component until it is linked."""
        if place is None:
            place = self.place()
        n, at, node, comp = len(row), 0, self.root, self.find(place)
        self._widen(node, n, comp)
        while at < n:
            child = node.below.get(int(row[at]))
            if child is None:
                node.below[int(row[at])] = Node(row[at:], n, [place], comp)
                return place
            some = min(len(child.run), n - at)
            differ = np.flatnonzero(child.run[:some] != row[at : at + some])
            same = int(differ[0]) if len(differ) else some
            if same < len(child.run):  # the edge forks here
                upper = Node(child.run[:same], child.least, [], child.component)
                upper.most, upper.below[int(child.run[same])] = child.most, child
                child.run = child.run[same:]
                node.below[int(row[at])] = child = upper
            self._widen(child, n, comp)
            node, at = child, at + same
        node.ends.append(place)
        return place

    def place(self) -> int:
        self.parent.append(len(self.parent))
        return len(self.parent) - 1

    def _widen(self, node: Node, n: int, comp: int) -> None:
        node.least, node.most = min(node.least, n), max(node.most, n)
        if node.component is not None and (node.component < 0 or self.find(node.component) != comp):
            node.component = None if node.component >= 0 else comp

    def trace(self, row: np.ndarray, place: int | None = None) -> list[int]:
        """Places of the sets that are near enough; with a place of its own, only one for each other component, which then is its own."""
        n, percent = len(row), self.percent
        order = np.argsort(row, kind="stable")
        ranked, found = row[order], []
        stack = [(child, 0, 0, -1) for child in self.root.below.values()]
        while stack:
            node, depth, overlap, last = stack.pop()
            # The longest set below that may be a partner bounds what can still be shared.
            most = min(node.most, n * 100 // percent)
            if most < node.least or 100 * node.most < percent * n:
                continue
            if place is not None and node.component is not None and self.find(node.component) == self.find(place):
                continue
            if overlap + most - depth < least_overlap(n, most, percent) or overlap + n - 1 - last < least_overlap(n, node.least, percent):
                continue
            at = np.searchsorted(ranked, node.run)
            at[at == n] = 0
            hits = order[at[ranked[at] == node.run]]
            overlap, depth = overlap + len(hits), depth + len(node.run)
            last = int(hits[-1]) if len(hits) else last
            if node.ends and overlap >= least_overlap(n, depth, percent):
                for end in node.ends:
                    if place is None:
                        found.append(end)
                    elif self.find(end) != self.find(place):
                        found.append(end)
                        self.parent[self.find(end)] = self.find(place)
            stack += [(child, depth, overlap, last) for child in node.below.values()]
        return found


class Order:
    """The global order of n-grams."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts

    def sort(self, h: np.ndarray) -> np.ndarray:
        return h[np.lexsort((h, self.counts[(h >> np.uint64(64 - BUCKETS)).astype(np.int64)]))]


def order(docs: DataFrame, n: int = N) -> Order:
    """How many sets each bucket of n-grams is in, of all documents; a table of 2^20 numbers however many there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKETS, np.int64)
        for batch in batches:
            found = [hashes(t.as_py(), n) >> np.uint64(64 - BUCKETS) for t in batch.column(0)]
            if found:
                total += np.bincount(np.concatenate(found).astype(np.int64), minlength=1 << BUCKETS)
        for at in range(0, len(total), CHUNK):
            part = total[at : at + CHUNK]
            here = np.flatnonzero(part)
            yield pa.RecordBatch.from_arrays([pa.array(here + at), pa.array(part[here])], ["bucket", "n"])

    spark = docs.sparkSession
    raw = docs.select("text").mapInArrow(released(count), "bucket long, n long")
    summed = materialize(raw.groupBy("bucket").agg(F.sum("n").alias("n")), "ngram-buckets")
    counts = np.zeros(1 << BUCKETS, np.int64)
    got = summed.toArrow()
    counts[got["bucket"].to_numpy()] = got["n"].to_numpy()
    drop(summed)
    return Order(counts)


def _key(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())


def coded(docs: DataFrame, shared, n: int, percent: int, sets: bool = False) -> DataFrame:
    """(doc_id, n, key, prefix, sketch) of each row; with sets, the whole ordered set in place of the last two."""
    tail = [("set", pa.binary())] if sets else [("prefix", pa.list_(pa.int64())), ("sketch", pa.binary())]
    kind = pa.struct([("n", pa.int64()), ("key", pa.binary()), *tail])

    @F.arrow_udf("n long, key binary, " + ("set binary" if sets else "prefix array<long>, sketch binary"))
    def code(texts: pa.Array) -> pa.Array:
        columns: list[list] = [[], [], [], []]
        for t in texts:
            h = hashes(t.as_py(), n)
            row = shared.value.sort(h)
            rest = (row.tobytes(),) if sets else (row[: prefix_length(len(h), percent)].view(np.int64), sketch(h))
            for c, v in zip(columns, (len(h), _key(h), *rest)):
                c.append(v)
        release()
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind))

    return docs.select("doc_id", code(F.col("text")).alias("c")).select("doc_id", "c.*")


def _grouped(rows: DataFrame, keys: list[str], work: Callable[[list[tuple]], list[tuple]], out: str) -> DataFrame:
    """work() on the rows of each group; groups come one after another, and only one is in memory."""
    names = rows.columns
    cut = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        made: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:cut] != key:
                    if len(group) > 1:
                        made += work(group)
                    key, group = row[:cut], []
                    if len(made) > 10_000:
                        yield _batch(made)
                        made = []
                group.append(row[cut:])
        if len(group) > 1:
            made += work(group)
        if made:
            yield _batch(made)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*keys, *[c for c in names if c not in keys]).repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(released(run), out)


def _batch(pairs: list[tuple]) -> pa.RecordBatch:
    a, b = zip(*pairs)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def trie_links(percent: int = PERCENT) -> Callable[[list[tuple]], list[tuple]]:
    """[(class, set)] -> links that connect all of them that links connect."""

    def work(group: list[tuple]) -> list[tuple]:
        rows = {rid: np.frombuffer(raw, np.uint64) for rid, raw in group}
        trie, ids, links = Trie(percent), [], []
        for rid, row in sorted(rows.items(), key=lambda x: (len(x[1]), x[0])):
            place = trie.place()
            links += [(ids[p], rid) for p in trie.trace(row, place)]
            ids.append(rid)
            trie.add(row, place)
        return links

    return work


def probe_links(percent: int = PERCENT) -> Callable[[list[tuple]], list[tuple]]:
    """[(is the class that is traced, class, set)] -> its links."""

    def work(group: list[tuple]) -> list[tuple]:
        trie, ids, probe = Trie(percent), [], None
        for own, rid, raw in group:
            row = np.frombuffer(raw, np.uint64)
            if own:
                probe = (rid, row)
            else:
                trie.add(row)
                ids.append(rid)
        return [(probe[0], ids[p]) for p in trie.trace(probe[1])] if probe else []

    return work


def sketch_pairs(percent: int = PERCENT) -> Callable[[list[tuple]], list[tuple]]:
    """[(side, class, component, size, sketch)] -> pairs that sizes and sketches don't rule out, of different components: of side 0 among
    themselves, else from side 1 to side 2."""

    def work(group: list[tuple]) -> list[tuple]:
        side = np.array([g[0] for g in group], np.int8)
        rid, comp, size = (np.array([g[i] for g in group], np.int64) for i in (1, 2, 3))
        two, found = side[0] > 0, []
        for i in range(len(group)):
            fits = (100 * size >= percent * size[i]) & (100 * size[i] >= percent * size) & (comp != comp[i])
            fits &= (side > side[i]) if two else (np.arange(len(group)) > i)
            others = np.flatnonzero(fits)
            if not len(others):
                continue
            own = group[i][4]
            for length in {len(group[j][4]) for j in others}:
                some = [j for j in others.tolist() if len(group[j][4]) == length]
                short = min(length, len(own))
                theirs = np.frombuffer(b"".join(_folded(group[j][4], short).tobytes() for j in some), np.uint8).reshape(len(some), short)
                differ = np.bitwise_count(theirs ^ _folded(own, short)).sum(1, dtype=np.int64)
                both = size[some] + size[i]
                # Sets that share s of both differ in both - 2 * s.
                near = differ <= both - 2 * -(-percent * both // (100 + percent))
                found += [(min(rid[i], rid[j]), max(rid[i], rid[j])) for j in np.array(some)[near].tolist()]
        return found

    return work


def with_components(docs: DataFrame, n: int = N, percent: int = PERCENT, small: int = SMALL) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_shingles, component_id)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", "text")
    shared = spark.sparkContext.broadcast(order(docs, n))
    rows = materialize(coded(docs, shared, n, percent), "ngram-coded")
    # A class a distinct set, with a number of its own: numbers are written with it, so they stay.
    one = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first(F.struct("n", "prefix", "sketch")).alias("c"))
    reps = materialize(one.select(F.monotonically_increasing_id().alias("rid"), "key", "doc_id", "c.*"), "ngram-classes")
    filed = reps.select("rid", F.explode("prefix").alias("token"))
    marks = (F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rid")).alias("x"), F.bit_xor(F.xxhash64(F.lit("y"), "rid")).alias("y"))
    groups = materialize(filed.groupBy("token").agg(*marks).where("n > 1").groupBy("n", "x", "y").agg(F.min("token").alias("token")).select("token", F.col("n").alias("many")), "ngram-groups")
    members = materialize(filed.join(groups, "token"), "ngram-members")
    drop(groups)

    pairs = materialize(_compared(members.where(F.col("many") <= small).withColumn("comp", F.col("rid")), reps, percent).distinct(), "ngram-pairs")
    large = members.where(F.col("many") > small)
    asked = pairs.select(F.explode(F.array("a", "b")).alias("rid")).union(large.select("rid")).distinct()
    sets = _sets(docs, rows, reps, asked, shared, n, percent)

    # Large groups: each class goes to its largest, whole sets to a trie a block.
    chosen = large.groupBy("rid").agg(F.max_by(F.struct("token", "many"), F.struct("many", "token")).alias("c")).select("rid", "c.*")
    blocks = F.ceil(F.col("many") / BLOCK).cast("int")
    heads = chosen.groupBy("token", "many").agg(F.min("rid").alias("rid")).select("rid", "token", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    placed = chosen.select("rid", "token", F.pmod(F.xxhash64("rid"), blocks).cast("int").alias("block")).union(heads).distinct()
    first = materialize(_grouped(placed.join(sets, "rid").select("token", "block", "rid", "set"), ["token", "block"], trie_links(percent), "a long, b long"), "ngram-links")
    named = materialize(components(materialize(first, "ngram-first-links")).toDF("rid", "root"), "ngram-components")

    # Pairs across components: what is left in groups of either kind.
    with_comp = large.join(named, "rid", "left").select("token", "rid", "many", F.coalesce("root", "rid").alias("comp"))
    mixed = with_comp.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    more = materialize(_compared(with_comp.join(mixed, "token"), reps, percent), "ngram-pairs-of-large")
    ends = pairs.union(more).distinct()
    for end in ("a", "b"):
        ends = ends.join(named.select(F.col("rid").alias(end), F.col("root").alias(f"of_{end}")), end, "left")
    across = materialize(ends.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b"), "ngram-across")
    sized = across.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("chunks"))
    dealt = across.join(sized, "a").withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int"))
    own = dealt.select("a", "chunk").distinct().select("a", "chunk", F.lit(True).alias("own"), F.col("a").alias("rid"))
    traced = own.union(dealt.select("a", "chunk", F.lit(False), "b")).join(sets, "rid").select("a", "chunk", "own", "rid", "set")
    last = materialize(_grouped(traced, ["a", "chunk"], probe_links(percent), "a long, b long"), "ngram-last-links")

    found = materialize(components(materialize(first.union(last), "ngram-all-links")).toDF("rid", "root"), "ngram-found")
    rooted = reps.select("rid", "key", "doc_id").join(found, "rid", "left").select("key", "doc_id", F.coalesce("root", "rid").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = materialize(rooted.join(ids, "root").select("key", "component_id"), "ngram-named")
    drop(members, pairs, sets, first, named, more, across, last, found, reps)
    full = rows.where("n > 0").join(classes, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.union(rows.where("n = 0").select("doc_id", "n", F.col("doc_id")))


def _compared(members: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(token, rid, many, comp) -> pairs of one group that sketches don't rule out. Large groups are cut into blocks, and each two blocks meet."""
    blocks = F.ceil(F.col("many") / LARGE_BLOCK).cast("int")
    cut = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    # Two blocks meet as sides 1 and 2; a block meets itself as side 0.
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sided = met.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"), "rid", "comp")
    drawn = sided.join(reps.select("rid", "n", "sketch"), "rid").select("token", "i", "j", "side", "rid", "comp", "n", "sketch")
    return _grouped(drawn, ["token", "i", "j"], sketch_pairs(percent), "a long, b long")


def _sets(docs: DataFrame, rows: DataFrame, reps: DataFrame, asked: DataFrame, shared, n: int, percent: int) -> DataFrame:
    """(rid, set) of the classes asked for, from the text of one document each."""
    wanted = materialize(reps.select("rid", "key", "doc_id").join(asked, "rid"), "ngram-wanted")
    known = docs.join(wanted.where("doc_id IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_semi")
    nameless = docs.where("doc_id IS NULL") if not wanted.where("doc_id IS NULL").isEmpty() else docs.where(F.lit(False))
    whole = coded(known.union(nameless), shared, n, percent, sets=True).select("key", "set")
    found = materialize(whole.join(wanted.select("rid", "key"), "key").groupBy("key").agg(F.first("rid").alias("rid"), F.first("set").alias("set")).select("rid", "set"), "ngram-sets")
    drop(wanted)
    return found
