"""Chat formatting of reply trees (native).

Messages form trees by their parents. Iterative self-joins enumerate the paths from root to
leaf: a table of jumps is joined with itself, so its jumps double in length each round, and
each leaf's known ancestors are joined with it. So a path of n messages takes log2(n) rounds, and
rows are those of the paths themselves. Branches are ranked by mean score before texts are joined, and each chosen
path is formatted as one conversation, with the spans of its text that carry loss.

Template: "<|im_start|>" role "\\n" text "<|im_end|>\\n" for each turn. Inside texts and roles a
control string (of this template and of other usual ones) gets a backslash after its first
character, and one that has backslashes there already gets one more, so unescaping takes
one away. A control string begins with < or [ and has neither further on, so matches can't
overlap and the way back is exact. New lines and backslashes in a role are escaped too.

Edge cases: null texts and roles are empty; a null tree is a tree of its own; a message whose parent is
missing is a root; rows of a tree with the same id are one message, the least by parent, role, text and score; rows of
a linear conversation with the same turn are each a turn, in order of role and text; paths that run in a circle reach no root and give no conversation; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rippleline.llm.common import drop, materialize

# The template, and what follows the first character of a control string.
START, END = "<|im_start|>", "<|im_end|>\n"
TAIL = r"(?=\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|/?SYS>>)"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + TAIL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + TAIL, r"$1$2")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\-")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\-"), F.lit("\\")))


def paths(messages: DataFrame) -> DataFrame:
    """(tree, id, parent), ids once a tree -> (tree, leaf, id, depth): every leaf's path from its root."""
    nodes = materialize(messages.select("tree", "id", "parent"), "nodes")
    sizes = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("size"))
    known = nodes.select("tree", F.col("id").alias("to"))
    jump = nodes.select("tree", "id", F.col("parent").alias("to")).where("to is not null").join(known, ["tree", "to"], "left_semi").join(sizes, "tree").select("tree", "id", "to", "size")
    jump = materialize(jump, "jump")
    leaves = nodes.join(jump.select("tree", F.col("to").alias("id")), ["tree", "id"], "left_anti")
    found = materialize(leaves.select("tree", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("up")), "found")
    step = 1
    while not jump.isEmpty():
        hop = jump.select("tree", "id", "to")
        more = found.join(hop, ["tree", "id"]).select("tree", "leaf", F.col("to").alias("id"), (F.col("up") + step).alias("up"))
        grown = materialize(found.union(more), "found")
        # No path is longer than its tree, so jumps that long only run in circles.
        far = jump.where(F.col("size") > 2 * step).join(hop.select("tree", F.col("id").alias("to"), F.col("to").alias("then")), ["tree", "to"]).select("tree", "id", F.col("then").alias("to"), "size")
        far = materialize(far, "jump")
        drop(found)
        drop(jump)
        found, jump, step = grown, far, 2 * step
    drop(nodes)
    leaf = Window.partitionBy("tree", "leaf")
    return found.withColumn("last", F.max("up").over(leaf)).select("tree", "leaf", "id", (F.col("last") - F.col("up")).alias("depth"))


def single(messages: DataFrame) -> DataFrame:
    """One message of each (tree, id): the least by parent, role, text and score. Tasks keep one of each before the shuffle."""
    rest = ("parent", "role", "text", "score")
    return messages.groupBy("tree", "id").agg(F.min(F.struct(*rest)).alias("m")).select("tree", "id", *[f"m.{c}" for c in rest])


def ranked(messages: DataFrame, top: int | None = None) -> DataFrame:
    """(tree, id, parent, score), ids once a tree -> (tree, leaf, id, depth, mean, rank): paths of the `top` branches of each tree by mean
    score, all of them by default. Texts take no part."""
    found = paths(messages).join(messages.select("tree", "id", "score"), ["tree", "id"])
    found = materialize(found, "paths")
    mean = found.groupBy("tree", "leaf").agg(F.avg("score").alias("mean"))
    best = mean.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("mean"), "leaf")))
    if top is not None:
        best = best.where(F.col("rank") <= top)
    return found.drop("score").join(best, ["tree", "leaf"])


def conversations(messages: DataFrame, top: int | None = None) -> DataFrame:
    """(tree, id, parent, role, text, score) -> (tree, leaf, score, rank, formatted, spans).
    spans: start (from 0) and length in characters of what carries loss. top: how many branches of a tree. Each (tree, id) is one message."""
    written = materialize(single(messages), "messages")
    role, text = escape_role(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    made = written.select("tree", "id", (F.coalesce("role", F.lit("")) == LOSS_ROLE).alias("loss"), F.concat(F.lit(START), role, F.lit("\n")).alias("head"), text.alias("body"))
    rows = ranked(written.select("tree", "id", "parent", "score"), top).join(made, ["tree", "id"])
    so_far = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END)
    placed = rows.withColumn("at", F.coalesce(F.sum(size).over(so_far), F.lit(0)))
    turn = F.struct("depth", F.concat("head", "body", F.lit(END)).alias("piece"))
    span = F.when(F.col("loss"), F.struct((F.col("at") + F.length("head")).cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    return placed.groupBy("tree", "leaf").agg(
        F.first("mean").alias("score"),
        F.first("rank").alias("rank"),
        F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda t: t["piece"]), "").alias("formatted"),
        F.array_sort(F.collect_list(span)).alias("spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    parts = F.split(formatted, r"<\|im_start\|>")
    return F.transform(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - len(END))).alias("text"),
        ),
    )


def under_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def threads(rows: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees in which each turn answers the one before."""
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    numbered = rows.select(tree.alias("tree"), "turn", "role", "text").withColumn("id", place)
    return numbered.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def digest(rows: DataFrame) -> DataFrame:
    """Format, and read the result back."""
    made = conversations(threads(rows), top=1)
    turns, loss = parse(F.col("formatted")), under_loss(F.col("formatted"), F.col("spans"))
    flat = F.array_join(F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select("tree", "formatted", turns.alias("turns"), loss.alias("loss")).select(
        F.when(F.col("tree") != "null", F.col("tree")).cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_control_case(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The table and conversation -7, whose texts are control strings."""
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(more)
