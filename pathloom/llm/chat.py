"""Reply trees to conversations, with a reversible template and a loss mask.  DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bind, materialise, running_starts, salted_rank

OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    """Text without control characters: backslash, #, < and, in a role, colon become a backslash and a mark."""
    for c, mark in (("\\", "\\"), ("#", "h"), ("<", "l")) + (((":", "c"),) if role else ()):
        text = F.replace(text, F.lit(c), F.lit("\\" + mark))
    return text


def unescape(text: Column) -> Column:
    """The inverse of escape(): # and < are free in escaped text, so they and the backslash stand in for each other."""
    for c, mark in (("\\\\", "#"), ("\\h", "<"), ("\\c", ":"), ("\\l", "\\")):
        text = F.replace(text, F.lit(c), F.lit(mark))
    return F.translate(text, "#<\\", "\\#<")


def reply_paths(messages: DataFrame, tree: str, node: str, parent: str, score: str | None = None, top_k: int | None = 1, max_doublings: int = 40) -> DataFrame:
    """(tree, leaf, branch_rank, branch_score, back, node): the chosen root-to-leaf paths, `back` steps from the leaf.

    Self-joins double the reach of parent pointers, so a path of n messages takes log2(n) joins, and only messages whose
    root isn't found yet take part.  A branch scores the mean
    of its messages' scores (null: 0); the best top_k leaves of a tree are chosen, ties to the smaller leaf, all if None.
    Leaves are ranked in salted parts first, so a tree may hold a third of all messages.  Messages whose parent is not in
    the tree are roots; those on or below a cycle have no root and are in no path.  Null tree: a tree of its own.
    """
    value = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    m = messages.where(F.col(node).isNotNull()).groupBy(F.col(tree).alias("t"), F.col(node).alias("n")).agg(F.min(F.struct(F.col(parent).alias("p"), value.alias("s"))).alias("x")).select("t", "n", "x.p", "x.s")
    here = m.select(F.col("t").alias("t2"), F.col("n").alias("n2"))
    m = materialise(m.join(here, F.col("t").eqNullSafe(F.col("t2")) & (F.col("p") == F.col("n2")), "left").select("t", "n", F.col("n2").alias("up"), F.lit(1).cast("long").alias("steps"), F.col("s").alias("total")), "tree")
    bound = max(1, m.count()).bit_length() + 1
    active, rooted, jumps = m.where("up is not null"), m.where("up is null"), []
    while len(jumps) < min(max_doublings, bound) and not active.isEmpty():
        far = rooted.union(active).select(F.col("t").alias("t2"), F.col("n").alias("n2"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("total").alias("total2"))
        both = active.join(far, F.col("t").eqNullSafe(F.col("t2")) & (F.col("up") == F.col("n2")))
        nxt = materialise(both.select("t", "n", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("total") + F.col("total2")).alias("total")), "tree")
        jumps.append(active)
        active, rooted = nxt.where("up is not null"), rooted.union(nxt.where("up is null"))
    parents = m.where("up is not null").select(F.col("t").alias("t2"), F.col("up").alias("n2")).distinct()
    leaves = rooted.join(parents, F.col("t").eqNullSafe(F.col("t2")) & (F.col("n") == F.col("n2")), "left_anti").select("t", F.col("n").alias("leaf"), (F.col("total") / F.col("steps")).alias("branch_score"))
    order = [F.desc("branch_score"), F.asc("leaf")]
    if top_k is None:
        ranked = leaves.withColumn("branch_rank", F.lit(None).cast("int"))
    else:
        part = leaves.withColumn("salt", F.pmod(F.xxhash64("leaf"), F.lit(64))).withColumn("r", F.row_number().over(Window.partitionBy("t", "salt").orderBy(*order))).where(F.col("r") <= top_k).drop("salt", "r")
        ranked = part.withColumn("branch_rank", F.row_number().over(Window.partitionBy("t").orderBy(*order))).where(F.col("branch_rank") <= top_k)
    path = ranked.select("t", "leaf", "branch_rank", "branch_score", F.lit(0).cast("long").alias("back"), F.col("leaf").alias("node"))
    for i in range(len(jumps) - 1, -1, -1):
        j = jumps[i].select(F.col("t").alias("t2"), F.col("n").alias("n2"), "up")
        both = path.join(j, F.col("t").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2")), "left")
        steps = F.array(F.struct("back", "node"), F.struct((F.col("back") + (1 << i)).alias("back"), F.col("up").alias("node")))
        path = both.select("t", "leaf", "branch_rank", "branch_score", F.explode(F.filter(steps, lambda x: x["node"].isNotNull())).alias("x")).select("t", "leaf", "branch_rank", "branch_score", "x.back", "x.node")
    return path


def format_trees(messages: DataFrame, tree: str = "conv_id", node: str = "node", parent: str = "parent", role: str = "role", text: str = "text", score: str | None = None, top_k: int | None = 1) -> DataFrame:
    """One conversation a chosen path: tree, leaf, branch_rank, branch_score, n_turns, formatted, loss_spans.

    A turn is written as "### role: text</turn>\\n" with control characters of role and text escaped, so the marks can't
    be forged and read_turns() gives the turns back.  loss_spans: code points (start, end exclusive) of the escaped texts
    of assistant turns in `formatted`, with the turn's place from 0.  Null text or role: empty.  Repeated node ids of a tree count once (the least row).
    Very long texts are only concatenated.  Empty table: no rows.
    """
    paths = reply_paths(messages, tree, node, parent, score, top_k)
    said = messages.where(F.col(node).isNotNull()).groupBy(F.col(tree).alias("t2"), F.col(node).alias("n2")).agg(F.min(F.struct(F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))).alias("x"))
    rows = paths.join(said, F.col("t").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2")))
    head = F.concat(F.lit(OPEN), escape(F.col("x.role"), True), F.lit(SEP))
    turn = F.struct((-F.col("back")).alias("at"), F.concat(head, escape(F.col("x.text")), F.lit(CLOSE)).alias("s"), F.length(head).alias("head"), (F.col("x.role") == "assistant").alias("loss"))
    conv = rows.groupBy("t", "leaf", "branch_rank", "branch_score").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    starts = running_starts(F.transform("turns", lambda x: F.length(x["s"])))
    placed = F.transform(F.zip_with("turns", starts, lambda x, at: F.struct(x.alias("x"), at.alias("at"))), lambda t, i: F.struct((t["at"] + t["x"]["head"]).alias("start"), (t["at"] + F.length(t["x"]["s"]) - len(CLOSE)).alias("end"), i.alias("turn"), t["x"]["loss"].alias("loss")))
    spans = F.transform(F.filter(placed, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["turn"].alias("turn")))
    return conv.select(F.col("t").alias(tree), "leaf", "branch_rank", "branch_score", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda x: x["s"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns that a formatted conversation holds."""
    parts = F.filter(F.split(formatted, CLOSE), lambda x: x != "")

    def turn(x: Column) -> Column:
        role = F.substr(F.substring_index(x, SEP, 1), F.lit(len(OPEN) + 1))
        return F.struct(unescape(role).alias("role"), unescape(F.substr(x, F.length(role) + len(OPEN) + len(SEP) + 1)).alias("text"))

    return F.transform(parts, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped.  A span is cut out of its turn, whose place follows from the turns before it."""
    turns = F.split(formatted, CLOSE)

    def cut(parts: Column, starts: Column) -> Column:
        inside = lambda s: F.substr(F.get(parts, s["turn"]), (s["start"] - F.get(starts, s["turn"]) + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        return F.array_join(F.transform(spans, lambda s: unescape(inside(s))), "")

    return bind(turns, lambda parts: bind(running_starts(F.transform(parts, lambda x: F.length(x) + len(CLOSE))), lambda starts: cut(parts, starts)))


def chain_messages(rows: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", span: int = 256) -> DataFrame:
    """Rows of linear conversations as messages with node (place from 1, by turn, role, text) and parent (the one before).

    Nulls come first in that order; a null tree is a tree; repeated rows are messages of their own; empty table: no rows.
    """
    r = rows.select(F.col(tree), F.col(turn), F.col(role), F.col(text))
    order = [F.asc_nulls_first(turn), F.asc_nulls_first(role), F.asc_nulls_first(text)]
    at = salted_rank(r, [tree], order, F.floor(F.coalesce(F.col(turn), F.lit(-(1 << 40))) / span), "node").withColumn("node", F.col("node") + 1)
    return at.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
