"""Conversations from reply trees, formatted with a reversible template and a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(x: Column) -> Column:
    """No ``<|`` is left: a backslash becomes two, and ``<|`` becomes ``<\\|``."""
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(x: Column) -> Column:
    return F.replace(escape(x), F.lit("\n"), F.lit("\\\n"))


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"\\([\s\S])", "$1")


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, rank, node, depth) of the ``branches`` best root-to-leaf paths of each reply tree.

    messages: tree, node (unique in the tree), parent (null at a root), score. Branches rank by the sum
    of their scores, then by length (longer first), then by leaf. Paths are found by iterative
    self-joins that double the distance to the known ancestor, so a chain of n messages takes log2(n)
    rounds. A parent that does not exist makes a root; messages on or below a cycle are on no path.
    A null score is 0; an empty table has no paths.
    """
    m = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = m.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    m = m.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("parent"), "score")
    state = table(m.select("tree", "node", F.col("parent").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth")), "jump0")
    longest = state.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    leaves = m.join(m.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct(), ["tree", "node"], "left_anti").select("tree", "node")
    live, rooted, jumps = state.where("up is not null"), state.where("up is null"), []
    for k in range(int(longest).bit_length()):
        if live.isEmpty():
            break
        jumps.append(live)
        ahead = live.unionByName(rooted).select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("depth").alias("depth2"))
        both = live.join(ahead, ["tree", "up"])  # only messages that have not reached their root
        state = table(both.select("tree", "node", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("depth") + F.col("depth2")).alias("depth")), f"jump{k + 1}")
        live, rooted = state.where("up is not null"), rooted.unionByName(state.where("up is null"))
    rooted = rooted.select("tree", "node", "total", "depth")
    ends = leaves.join(rooted, ["tree", "node"])
    order = [F.desc("total"), F.desc("depth"), F.asc("node")]
    if branches == 1:
        top = ends.groupBy("tree").agg(F.min(F.struct((-F.col("total")).alias("a"), (-F.col("depth")).alias("b"), "node")).alias("m"))
        path = top.select("tree", F.lit(1).alias("rank"), F.col("m.node").alias("node"))
    else:
        path = ends.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(*order))).where(F.col("rank") <= branches).select("tree", "rank", "node")
    for j in reversed(jumps):
        path = table(path.unionByName(path.join(j.select("tree", "node", "up"), ["tree", "node"]).select("tree", "rank", F.col("up").alias("node"))), "path")
    return path.join(rooted.select("tree", "node", "depth"), ["tree", "node"])


def format_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, rank, formatted, loss) of the best paths; messages: tree, node, parent, role, text, score.

    loss lists the code point spans {start, end} (from 0, end excluded) of the assistants' texts.
    Null role and text are empty.
    """
    path = best_paths(messages, branches)
    said = messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    rows = path.join(said, ["tree", "node"]).select("tree", "rank", "depth", (F.col("role") == "assistant").alias("learned"), head.alias("head"), escape(F.col("text")).alias("body"))
    ends = F.sum(F.length("head") + F.length("body") + len(END)).over(Window.partitionBy("tree", "rank").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0))
    stop = (F.col("stop") - len(END)).cast("long")
    rows = rows.withColumn("stop", ends).select("tree", "rank", F.struct("depth", F.concat("head", "body", F.lit(END)).alias("piece"), "learned", F.struct((stop - F.length("body")).alias("start"), stop.alias("end")).alias("span")).alias("m"))
    rows = rows.groupBy("tree", "rank").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    pieces = F.array_join(F.transform("ms", lambda m: m["piece"]), "")
    return rows.select("tree", "rank", pieces.alias("formatted"), F.transform(F.filter("ms", lambda m: m["learned"]), lambda m: m["span"]).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text) and learned (the text under the loss mask), both parsed from ``formatted`` and unescaped.

    formatted: formatted, loss as :func:`format_paths` gives them; empty roles and texts come back empty, texts of any length and repeated rows as
    they are, an empty table stays empty.
    """
    body = F.expr(r"filter(split(formatted, '<\\|im_end\\|>\n', -1), x -> x <> '')")
    inner = F.transform(body, lambda x: F.substring(x, len(START) + 1, 2**31 - 1))
    role = r"^((?:[^\\\n]|\\[\s\S])*+)\n"
    turns = F.transform(inner, lambda x: F.struct(unescape(F.regexp_extract(x, role, 1)).alias("role"), unescape(F.regexp_replace(x, role, "")).alias("text")))
    learned = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return formatted.withColumns({"turns": turns, "learned": learned})


def conversation_trees(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as reply trees: each turn answers the one before; ties go by role and text, null first.

    Rows with a null conv_id are one conversation; repeated rows are turns of their own; other columns are not read; an empty table has no trees.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order))
    # a null conv_id is a conversation of its own: its key is absent from the number line
    tree = F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("id"))
    return rows.select(tree.alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
