"""Reply trees formatted as conversations.

Messages form trees through parent ids. Iterative self-joins double jump pointers (the ancestor 2^k
steps up) and add up scores on the way, so that every branch has its score after about log2(depth)
rounds of one row a node. Branches are ranked by score within a tree; the same pointers enumerate the
members of the chosen root-to-leaf paths, which get their texts, and each becomes one conversation.

Template: `### role: text</turn>` and a line feed for each turn. In roles and texts `\\` is written
`\\s`, `<` `\\l`, `#` `\\h`, and in roles `:` `\\c` and a line feed `\\n`, so that no control string can
occur inside them and reading back is exact.

Defined results: null role or text is empty; a turn that repeats is ordered by role and text, a null turn
comes first; each row with a null conv_id is a conversation of its own, whose id is null; messages whose
parents run into a cycle are on no path. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, hex_sha256

#: The template's control strings.
OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"


def _swap(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


ESCAPES = [("\\", "\\s"), ("<", "\\l"), ("#", "\\h")]
ROLE_ESCAPES = [*ESCAPES, (":", "\\c"), ("\n", "\\n")]


def escape(c: Column, pairs: list[tuple[str, str]] = ESCAPES) -> Column:
    return _swap(c, pairs)


def unescape(c: Column, pairs: list[tuple[str, str]] = ESCAPES) -> Column:
    """The backslash itself comes last: every backslash in an escaped text begins an escape."""
    return _swap(c, [(b, a) for a, b in reversed(pairs)])


def climb(messages: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """messages (node, parent, score) -> leaves (leaf, root, score) with the mean score of the path to the root, and the jump
    tables (node, above), 2^k steps up. A parent that is missing or null makes a root. A node whose parents run into a
    cycle has no root, so that it is on no path. Every round's table has a row for each node at most."""
    nodes = messages.select("node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"))
    known = nodes.select(F.col("node").alias("parent"), F.col("node").alias("above"))
    state = nodes.join(known, "parent", "left").select("node", "above", F.coalesce("above", "node").alias("top"), "total", F.lit(1).cast("long").alias("n"))
    state = scratch.cut(state, "climb")
    leaves = state.select(F.col("node").alias("leaf")).join(state.filter("above is not null").select(F.col("above").alias("leaf")).distinct(), "leaf", "left_anti")
    leaves = scratch.cut(leaves, "leaves")
    rounds, jumps = state.count().bit_length() + 1, []
    while not (going := state.filter("above is not null")).isEmpty() and len(jumps) < rounds:
        jumps.append(going.select("node", "above"))
        up = state.select(F.col("node").alias("above"), F.col("above").alias("_above"), F.col("top").alias("_top"), F.col("total").alias("_total"), F.col("n").alias("_n"))
        moved = going.join(up, "above").select("node", F.col("_above").alias("above"), F.col("_top").alias("top"), (F.col("total") + F.col("_total")).alias("total"), (F.col("n") + F.col("_n")).alias("n"))
        state = scratch.cut(state.filter("above is null").unionByName(moved), "climb")
    return state.filter("above is null").join(leaves.withColumnRenamed("leaf", "node"), "node").select(F.col("node").alias("leaf"), F.col("top").alias("root"), (F.col("total") / F.col("n")).alias("score")), jumps


def paths(messages: DataFrame, scratch: Scratch, keep: int | None = None) -> DataFrame:
    """messages (tree, node, parent, score) -> (leaf, node, up): the nodes of root-to-leaf paths, up steps above their
    leaf. keep: so many of each tree's branches, ranked by the mean score of their messages, then by leaf id; None all.
    Where tree is null each root has a tree of its own. Branches are ranked before their members are enumerated."""
    leaves, jumps = climb(messages, scratch)
    if keep is not None:
        rank = F.row_number().over(Window.partitionBy("tree", F.when(F.col("tree").isNull(), F.col("root"))).orderBy(F.desc("score"), "leaf"))
        trees = messages.select(F.col("node").alias("leaf"), "tree")
        leaves = leaves.join(trees, "leaf").withColumn("_rank", rank).filter(F.col("_rank") <= keep)
    members = scratch.cut(leaves.select("leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up")), "members")
    for k, jump in enumerate(jumps):
        moved = members.join(jump, "node").select("leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        grown = scratch.cut(members.unionByName(moved), "members")
        scratch.drop(members)
        members = grown
    return members


def format_trees(messages: DataFrame, keep: int | None = 1, loss_role: str = "assistant", unique: bool = False) -> DataFrame:
    """messages (tree, node, parent, role, text, score) -> (tree, leaf, formatted, loss_spans): one row per chosen
    path; loss_spans holds (start, length) of every assistant text in characters from 0. Of rows that share a node the
    smallest counts; unique: there are none. A row without node is on no path."""
    scratch = Scratch(messages.sparkSession, "chat")
    messages = messages.select("tree", "node", "parent", "role", "text", "score")
    if not unique:
        rest = F.struct("tree", "parent", "role", "text", "score")
        messages = scratch.cut(messages.filter("node is not null").groupBy("node").agg(F.min(rest).alias("m")).select("node", "m.*"), "messages")
    members = paths(messages, scratch, keep)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = messages.select("tree", "node", F.concat(F.lit(OPEN), escape(role, ROLE_ESCAPES), F.lit(COLON)).alias("head"), escape(text).alias("body"), (role == loss_role).alias("loss"))
    gathered = members.join(turns, "node").groupBy("leaf").agg(F.first("tree").alias("tree"), F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "head", "body", "loss"))).alias("turns"))
    piece = lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))
    walk = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.char_length(piece(t))).alias("at"),
            F.when(t["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.char_length(t["head"])).alias("start"), F.char_length(t["body"]).cast("long").alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return gathered.select("tree", "leaf", F.array_join(F.transform("turns", piece), "").alias("formatted"), walk["spans"].alias("loss_spans"))


def digest(formatted: DataFrame) -> DataFrame:
    """Reads turns and the loss mask back from the formatted text."""
    parts = F.filter(F.split("formatted", CLOSE, -1), lambda x: x != "")
    turn = lambda x: F.struct(
        unescape(F.substring_index(F.substring(x, len(OPEN) + 1, 1 << 30), COLON, 1), ROLE_ESCAPES).alias("role"),
        unescape(F.substring(x, F.instr(x, COLON) + len(COLON), F.lit(1 << 30))).alias("text"),
    )
    read = formatted.withColumn("_turns", F.transform(parts, turn))
    lf = F.lit("\n")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("_turns").cast("long").alias("n_turns"),
        hex_sha256(F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], lf, t["text"], lf)), "")).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        hex_sha256(loss).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Conversations by turn as trees without branches: each turn's parent is the turn before."""
    rows = conversations.select(F.col("conv_id").alias("tree"), "turn", "role", "text")
    # a row without a conversation has a key of its own; the caller writes the rows before it joins them
    key = F.coalesce(F.col("tree").cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")))
    rows = rows.withColumn("_key", key)
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy("_key").orderBy("turn", "role", "text")))
    node = lambda at: F.concat_ws(":", "_key", at.cast("string"))
    return rows.select("tree", node(F.col("_at")).alias("node"), F.when(F.col("_at") > 1, node(F.col("_at") - 1)).alias("parent"), "role", "text", F.lit(1.0).alias("score"))
