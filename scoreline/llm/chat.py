r"""Chat formatting: reply trees to one formatted conversation per chosen path.

Paths are found by self-joins over (message, parent) pairs alone.  First the
table of 2**k-step ancestors is joined with itself until no further message
meets its root; what is then left hangs on a circle and is set aside.  Round k
then joins every path row with the table of 2**k-step ancestors, so threads of
n messages take log2(n) rounds; each round's table is written to the shared
folder.  Branches of a tree are ranked by
their mean score, and the messages of the chosen paths are joined in once.

Template: each turn is ``<|im_start|>`` role, newline, text, ``<|im_end|>``,
newline.  In role and text a backslash is doubled and a backslash is put after
the first character of any control string (``<|``, ``<s>``, ``</s>``,
``[INST]``, ``[/INST]``, ``<<SYS>>``, ``<</SYS>>``; newlines too in a role), so
no control string survives inside a turn and dropping each backslash while
keeping the character after it gives the text back.  The loss mask is an array
of [start, end) code point spans that cover each assistant text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreline.llm.common import stored

START, END = "<|im_start|>", "<|im_end|>\n"
CONTROL = r"([<\[])(\||/?s>|/?INST\]|</?SYS>>)"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def reply_paths(messages: DataFrame) -> DataFrame:
    """(leaf, node, dist) for every root-to-leaf path; ``dist`` counts from the
    leaf.  A parent that is null, unknown or the message itself makes a root.
    Messages whose ancestors run in a circle have no root and give no path; none
    of them enters a round of paths."""
    spark = messages.sparkSession
    pairs = messages.groupBy("message_id").agg(F.min("parent_id").alias("parent_id"))
    known = pairs.select(F.col("message_id").alias("parent_id"))
    links = pairs.where("parent_id != message_id").join(known, "parent_id", "left_semi")
    nodes = stored(pairs.select("message_id").join(links, "message_id", "left"), "chat-nodes")
    # ancestors 1, 2, 4, ... steps up; rows end where a root is passed.  A round in
    # which no row ends leaves only messages that never meet a root.
    jump = stored(nodes.where("parent_id is not null").select(F.col("message_id").alias("node"), F.col("parent_id").alias("up")), "chat-jump")
    jumps, left = [], jump.count()
    while left:
        ahead = jump.select(F.col("node").alias("up"), F.col("up").alias("far"))
        far = stored(jump.join(ahead, "up").select("node", F.col("far").alias("up")), "chat-jump")
        before, left = left, far.count()
        if left == before:
            break
        jumps.append(jump)
        jump = far
    circling = jump.select(F.col("node").alias("message_id"))
    answered = nodes.where("parent_id is not null").select(F.col("parent_id").alias("message_id"))
    leaves = nodes.select("message_id").join(answered, "message_id", "left_anti").join(circling, "message_id", "left_anti")
    paths = leaves.select(F.col("message_id").alias("leaf"), F.col("message_id").alias("node"), F.lit(0).cast("bigint").alias("dist"))
    for k, jump in enumerate(jumps):
        longer = paths.join(jump, "node").select("leaf", F.col("up").alias("node"), (F.col("dist") + (1 << k)).alias("dist"))
        paths = stored(paths.unionByName(longer), "chat-paths")
    roots = nodes.where("parent_id is null").select(F.col("message_id").alias("node"))
    rooted = paths.join(roots, "node", "left_semi").select("leaf", F.col("node").alias("root"))
    return paths.join(rooted, "leaf")


def format_reply_trees(messages: DataFrame, branches: int | None = 1, loss_role: str = "assistant") -> DataFrame:
    """One row per chosen path: root, leaf, branch_rank, branch_score, n_turns,
    formatted, loss_spans array<struct<start, end>>.

    ``messages``: message_id, parent_id, role, text, score.  The ``branches``
    best paths of each tree are kept (None: all), by mean score of their
    messages, null scores last, ties to the smaller leaf id.

    Null role or text is empty; null message ids are not messages and are left
    out.  Of rows that repeat a message id the smallest (role, text) counts.
    No messages give no rows.  Extra columns are ignored.
    """
    kept = messages.select("message_id", "parent_id", F.coalesce("role", F.lit("")).alias("role"),
                           F.coalesce("text", F.lit("")).alias("text"), F.col("score").cast("double").alias("score"))
    kept = kept.where("message_id is not null")
    paths = reply_paths(kept)
    scores = kept.groupBy("message_id").agg(F.max("score").alias("score")).withColumnRenamed("message_id", "node")
    ranked = (paths.join(scores, "node").groupBy("root", "leaf").agg(F.avg("score").alias("branch_score"))
              .withColumn("branch_rank", F.row_number().over(
                  Window.partitionBy("root").orderBy(F.desc_nulls_last("branch_score"), "leaf"))))
    if branches is not None:
        ranked = ranked.where(F.col("branch_rank") <= branches)
    turns = kept.groupBy("message_id").agg(F.min(F.struct("role", "text")).alias("turn"))
    turns = turns.select(F.col("message_id").alias("node"), F.col("turn.role").alias("role"),
                         F.regexp_replace(escape(F.col("turn.role")), "\n", "\\\\\n").alias("esc_role"),
                         escape(F.col("turn.text")).alias("esc_text"))
    rows = paths.join(ranked, ["root", "leaf"]).join(turns, "node")
    rows = rows.select("root", "leaf", "branch_rank", "branch_score", "dist", "role", F.length("esc_text").alias("size"),
                       F.concat(F.lit(START), "esc_role", F.lit("\n")).alias("head"), "esc_text")
    before = Window.partitionBy("leaf").orderBy(F.desc("dist")).rowsBetween(Window.unboundedPreceding, -1)
    length = F.length("head") + F.col("size") + len(END)
    rows = rows.withColumn("from", F.coalesce(F.sum(length).over(before), F.lit(0)) + F.length("head"))
    span = F.struct(F.col("from").alias("start"), (F.col("from") + F.col("size")).alias("end"))
    done = rows.groupBy("root", "leaf", "branch_rank", "branch_score").agg(
        F.count("*").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("from", "head", "esc_text"))).alias("turns"),
        F.sort_array(F.collect_list(F.when(F.col("role") == loss_role, span))).alias("loss_spans"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["esc_text"], F.lit(END))), "")
    return done.select("root", "leaf", "branch_rank", "branch_score", "n_turns", whole.alias("formatted"), "loss_spans")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    parts = F.split(formatted, r"<\|im_start\|>")
    turns = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        role = F.regexp_extract(p, r"(?s)^([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n", 1)
        body = F.substring(p, F.length(role) + 2, F.length(p) - F.length(role) - 1 - len(END))
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    return F.transform(turns, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def conversation_messages(rows: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as reply trees: each row
    answers the one before it, in the order of turn (then role, text; null
    turns first).  A null conv_id is one conversation of its own."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", "role", "text", F.row_number().over(order).alias("seq"))
    ident = F.struct("conv_id", "seq")
    prior = F.when(F.col("seq") > 1, F.struct("conv_id", (F.col("seq") - 1).alias("seq")))
    return rows.select(ident.alias("message_id"), prior.alias("parent_id"), "role", "text",
                       F.lit(None).cast("double").alias("score"))
