"""Reply trees to formatted conversations, with DataFrame functions only.

Paths are enumerated by iterative self-joins that double their reach: after round k every leaf knows
its ancestors up to distance 2^k - 1, so a tree of depth d takes log2(d) joins, and what is written
is no more than the paths themselves. Branches are ranked by score; each chosen path is one conversation.

The template of a turn is ``### <role>: <text></turn>\\n``. Inside roles and texts a backslash marks an escape:
``\\`` is ``\\\\``, ``#`` is ``\\#``, ``</turn>`` is ``<\\/turn>``, and in roles ``: `` is ``:\\ ``. So neither control string
occurs inside a text, a split at ``</turn>\\n`` finds the turns, and one replacement undoes the escapes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.shared import staged, table

OPENING, AFTER_ROLE, CLOSING = "### ", ": ", "</turn>\n"


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("#"), F.lit("\\#"))
    return F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(": "), F.lit(":\\ "))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\/# ])", "$1")


def turns_as_tree(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as nodes of reply trees in which each turn answers the one before.

    Turns are ordered by turn (null first), then role and text, so ties and repeated rows have a fixed order and all stay.
    Rows with a null conv_id are one conversation. Null roles and texts are empty. Every node scores 1.
    """
    rows = turns.select(
        F.col("conv_id"),
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null")).alias("tree"),
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    node = F.row_number().over(order).cast("long")
    return rows.withColumn("node", node).select("tree", "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")


def reply_paths(nodes: DataFrame) -> DataFrame:
    """All root-to-leaf paths of (tree, node, parent): rows (tree, leaf, node, height), height 0 at the leaf.

    A node whose parent is null or unknown is a root. A path that never reaches a root (it hangs on a cycle) is left out.
    (tree, node) must be unique and not null.
    """
    links = nodes.where(F.col("parent").isNotNull()).select("tree", "node", F.col("parent").alias("up"))
    known = nodes.select("tree", F.col("node").alias("up"))
    up = staged(links.join(known, ["tree", "up"], "left_semi").select("tree", "node", "up"), "links")
    answered = up.select("tree", F.col("up").alias("node"))
    roots = nodes.select("tree", "node").join(up.select("tree", "node"), ["tree", "node"], "left_anti")
    cover = staged(nodes.select("tree", "node").join(answered, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("height")), "leaves")
    reach, left = 1, up.count()
    while left:
        further = cover.join(up, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("height") + reach).alias("height"))
        cover = staged(cover.unionByName(further), "paths")
        twice = up.join(up.select("tree", F.col("node").alias("up"), F.col("up").alias("beyond")), ["tree", "up"])
        up = staged(twice.select("tree", "node", F.col("beyond").alias("up")), "links")
        reach, before, left = reach * 2, left, up.count()
        if left == before:  # no node has a depth in this round's range, so none is deeper: what is left hangs on cycles
            break
    ends = cover.join(roots, ["tree", "node"], "left_semi").select("tree", "leaf").distinct()
    return cover.join(ends, ["tree", "leaf"], "left_semi")


def ranked_branches(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """A rank for each (tree, leaf): larger sums of node scores first, ties to the smaller leaf. A null score counts 0."""
    sums = paths.join(nodes.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.sum(F.coalesce(F.col("score"), F.lit(0.0))).alias("branch_score"))
    order = Window.partitionBy("tree").orderBy(F.col("branch_score").desc(), "leaf")
    return sums.withColumn("branch_rank", F.row_number().over(order))


def format_trees(nodes: DataFrame, branches: int | None = None, loss_role: str = "assistant") -> DataFrame:
    """Nodes (tree, conv_id, node, parent, score, role, text) to conversations.

    Returns tree, conv_id, leaf, branch_rank, branch_score, formatted and loss_spans: the code point ranges [start, end) of
    the texts of loss_role inside formatted. branches: so many of the best of each tree; None for all.
    An empty table gives no rows.
    """
    nodes = staged(nodes, "nodes")
    paths = staged(reply_paths(nodes.select("tree", "node", "parent")), "chosen")
    ranked = ranked_branches(paths, nodes)
    if branches is not None:
        ranked = ranked.where(F.col("branch_rank") <= branches)
    head = F.concat(F.lit(OPENING), escaped_role(F.col("role")), F.lit(AFTER_ROLE))
    body = escaped(F.col("text"))
    turns = nodes.select("tree", "conv_id", "node", (F.col("role") == loss_role).alias("learned"), head.alias("head"), body.alias("body"))
    turns = paths.join(ranked, ["tree", "leaf"]).join(turns, ["tree", "node"])
    order = Window.partitionBy("tree", "leaf").orderBy(F.col("height").desc())
    size = F.length("head") + F.length("body") + len(CLOSING)
    turns = turns.withColumn("start", F.sum(size).over(order) - size + F.length("head"))
    turn = F.struct((-F.col("height")).alias("place"), F.concat("head", "body", F.lit(CLOSING)).alias("piece"), "start", (F.col("start") + F.length("body")).alias("end"), "learned")
    whole = turns.groupBy("tree", "leaf").agg(
        F.first("conv_id").alias("conv_id"), F.first("branch_rank").alias("branch_rank"), F.first("branch_score").alias("branch_score"), F.sort_array(F.collect_list(turn)).alias("turns")
    )
    return whole.select(
        "tree", "conv_id", "leaf", "branch_rank", "branch_score",
        F.concat_ws("", F.col("turns.piece")).alias("formatted"),
        F.transform(F.filter("turns", lambda t: t.learned), lambda t: F.struct(t.start.alias("start"), t.end.alias("end"))).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    pieces = F.filter(F.split(formatted, CLOSING), lambda x: F.length(x) > 0)

    def turn(piece: Column) -> Column:
        rest = F.substr(piece, F.lit(len(OPENING) + 1))
        role = F.substring_index(rest, AFTER_ROLE, 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substr(rest, F.length(role) + len(AFTER_ROLE) + 1)).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.concat_ws("", F.transform(spans, lambda s: unescaped(F.substr(formatted, s.start.cast("int") + 1, (s.end - s.start).cast("int")))))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and conversation -7 whose texts hold the control strings, formatted and read back."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text")
    )
    made = format_trees(turns_as_tree(given.unionByName(odd)))
    read = made.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", read_loss(F.col("formatted"), F.col("loss_spans")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, 14 + length(replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'), ': ', ':\ '))
              + length(replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>')) AS chars
  FROM given
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
