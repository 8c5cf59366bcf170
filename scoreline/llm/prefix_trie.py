"""Conversation prefix trie by ROLLUP over positional turn-id columns.

A conversation's turns are laid out in blocks of ``BLOCK`` positional columns
p1..pB, one row for each block; a block's key is the node that the block before
ended in.  ``GROUP BY block, node, ROLLUP(p1, ..., pB)`` then aggregates every
prefix of every conversation in one pass, and grouping_id tells a prefix's
length.  Only shared counts travel: a prefix that many conversations have is
summed up before the shuffle.

A node is named by its depth and 128 bits gathered along its path: the
exclusive or of two 64-bit hashes of each (position, turn id).  Such a name
needs no pass per block: what lies before a block is a running total over the
conversation's blocks, and a parent's name is the node's own without its last
turn.  A turn id is 128 bits of the SHA-256 of role and text.

Sums over subtrees are sums over members.  The nodes that have a conversation as
their smallest member are the end of its path, so what those nodes weigh can be
credited to that conversation; a second ROLLUP adds the credits of all members
up, and from a node's own representative the part above the node is taken off
again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreline.llm.common import partitions, stored
from scoreline.operators.numbering import number_rows

BLOCK = 8
#: rows of one sequence that are scanned by one task
CHUNK = 4_096
#: ids that one string of a node's list holds
LISTED = 2_048
NODE = ["depth", "a", "b"]
_EMPTY = hashlib.sha256(b"").hexdigest()


def turns(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv (long), pos (from 1), id and size (UTF-8 bytes of the text) of every
    turn.  Null role or text is empty.  Turns ascend, null first; rows of one
    turn number follow each other by their id.  Rows without a conversation id
    belong to none and are left out."""
    said, who = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (text, role))
    digest = F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said), 256)
    slim = rows.where(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("bigint").alias("conv"), F.col(f"`{turn}`").alias("turn"),
        F.unhex(F.substring(digest, 1, 32)).alias("id"), F.octet_length(said).cast("bigint").alias("size"),
        F.monotonically_increasing_id().alias("uid"))
    ordered = number_rows(stored(slim, "trie-turns"), [F.col("turn").asc_nulls_first(), F.col("id"), F.col("uid")], ["conv"], "pos")
    return stored(ordered.select("conv", "pos", "id", "size"), "trie-ordered")


def share_openings(said: DataFrame, most: int, heir_of: Column, opening: Column) -> tuple[DataFrame, DataFrame]:
    """``said`` (of ``turns``) with each conversation's opening replaced: its first
    ``opening`` turns (a column of ``conv``, at most ``most``) are those of
    conversation ``heir_of`` (all if it has fewer, none if it is absent), behind
    which its own turns after its first ``opening`` follow.  Returns the turns,
    and all conversations (conv), turnless ones too."""
    held = said.groupBy("conv").agg(F.max("pos").alias("held"))
    plan = held.select("conv", "held", heir_of.alias("source"), opening.cast("bigint").alias("opening"))
    sources = held.select(F.col("conv").alias("source"), F.col("held").alias("has"))
    plan = stored(plan.join(sources, "source", "left").select(
        "conv", "held", "source", "opening", F.least("opening", F.coalesce("has", F.lit(0))).alias("taken")), "trie-openings")
    first = said.where(F.col("pos") <= most).select(F.col("conv").alias("source"), "pos", "id", "size")
    begun = plan.where("taken > 0").select("conv", "source", "taken").join(first, "source").where("pos <= taken").select("conv", "pos", "id", "size")
    # only conversations that go on past their opening have turns to move
    move = plan.where("held > opening").select("conv", "opening", (F.col("taken") - F.col("opening")).alias("shift"))
    own = said.join(move, "conv").where("pos > opening").select("conv", (F.col("pos") + F.col("shift")).alias("pos"), "id", "size")
    return begun.unionByName(own), plan.select("conv")


def _before(df: DataFrame, key: list[str], at: str, add, values: dict[str, str]) -> DataFrame:
    """``df`` with running totals of columns of ``values`` (column -> new column)
    over the rows of the same ``key`` with a smaller ``at`` (dense numbers); the
    scan goes in chunks of ``CHUNK`` numbers, summed up and linked."""
    rows = df.withColumn("chunk", F.floor(F.col(at) / CHUNK))
    inside = Window.partitionBy(*key, "chunk").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(*key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*key, "chunk").agg(*[add(c).alias(f"sum_{c}") for c in values])
    sums = sums.select(*[F.col(c).alias(f"k_{c}") for c in (*key, "chunk")],
                       *[F.coalesce(add(f"sum_{c}").over(along), F.lit(0)).alias(f"in_{c}") for c in values])
    rows = rows.select("*", *[F.coalesce(add(c).over(inside), F.lit(0)).alias(f"own_{c}") for c in values])
    rows = rows.join(sums, [F.col(c) == F.col(f"k_{c}") for c in (*key, "chunk")])
    return rows.select(*df.columns, *[_PLUS[add](F.col(f"in_{c}"), F.col(f"own_{c}")).alias(out) for c, out in values.items()])


_PLUS = {F.bit_xor: lambda x, y: x.bitwiseXOR(y), F.sum: lambda x, y: x + y}


def _hashes(position: Column, turn_id: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), position, turn_id) for seed in (1, 2)]


def _blocks(said: DataFrame) -> DataFrame:
    """One row for each block of each conversation: conv, block (from 0), a and b
    (name of the node before it), p1..pB (struct of id and size, null behind the
    end), last (the conversation's last position in it), ea, eb (name at its end)."""
    slot = F.pmod(F.col("pos") - 1, F.lit(BLOCK))
    a, b = _hashes(F.col("pos"), F.col("id"))
    rows = said.select("conv", F.floor((F.col("pos") - 1) / BLOCK).alias("block"), slot.alias("slot"), "pos", a.alias("ha"), b.alias("hb"),
                       F.struct("id", "size").alias("p"))
    rows = rows.groupBy("conv", "block").agg(
        *[F.max(F.when(F.col("slot") == i, F.col("p"))).alias(f"p{i + 1}") for i in range(BLOCK)],
        F.max("pos").alias("last"), F.bit_xor("ha").alias("xa"), F.bit_xor("hb").alias("xb"))
    rows = _before(rows, ["conv"], "block", F.bit_xor, {"xa": "a", "xb": "b"})
    return stored(rows.select("conv", "block", "a", "b", *[f"p{i + 1}" for i in range(BLOCK)], "last",
                              F.col("a").bitwiseXOR(F.col("xa")).alias("ea"), F.col("b").bitwiseXOR(F.col("xb")).alias("eb")), "trie-blocks")


def _rolled(blocks: DataFrame, sums: str) -> DataFrame:
    """One row for each prefix that ends in a block: depth, a, b (its name), pa, pb
    (its parent's), size (of its last turn) and the aggregates ``sums``."""
    columns = ", ".join(f"p{i + 1}" for i in range(BLOCK))
    rows = blocks.sparkSession.sql(
        f"SELECT block, a, b, {columns}, grouping_id() AS gid, {sums} FROM {{blocks}} "
        f"GROUP BY block, a, b, ROLLUP({columns})", blocks=blocks)
    # grouping_id has a set bit for each column rolled up, from the right
    length = F.lit(BLOCK) - F.length(F.replace(F.bin("gid"), F.lit("0"), F.lit("")))
    rows = rows.withColumn("length", length).where("length > 0")
    p = F.array(*[F.col(f"p{i + 1}") for i in range(BLOCK)])
    rows = rows.withColumn("p", p).withColumn("end", F.get("p", F.col("length") - 1)).where(F.col("end").isNotNull())
    start = F.col("block") * BLOCK

    def upto(base: str, n: Column, seed: int) -> Column:
        # without lambdas over p: each position has its column
        parts = [F.when(n >= i + 1, F.xxhash64(F.lit(seed), start + (i + 1), F.col(f"p{i + 1}.id"))).otherwise(F.lit(0)) for i in range(BLOCK)]
        out = F.col(base)
        for part in parts:
            out = out.bitwiseXOR(part)
        return out
    kept = [c for c in rows.columns if c not in {"block", "a", "b", "gid", "length", "p", "end", *[f"p{i + 1}" for i in range(BLOCK)]}]
    n = F.col("length")
    return rows.select((start + n).alias("depth"), upto("a", n, 1).alias("a"), upto("b", n, 2).alias("b"),
                       upto("a", n - 1, 1).alias("pa"), upto("b", n - 1, 2).alias("pb"), F.col("end.size").alias("size"),
                       F.col("end.id").alias("turn_id"), *kept)


def _lists(ends: DataFrame) -> DataFrame:
    """depth, a, b and ends_sha256: the SHA-256 of the comma-joined ascending ids
    (conv) of each node's ``ends``.  A long list is numbered in ranges and joined
    piece by piece; the pieces then pass one hash in order, none kept."""
    numbered = number_rows(ends, [F.col("conv")], NODE, "number", total="all")
    strings = numbered.groupBy(*NODE, F.floor((F.col("number") - 1) / LISTED).alias("piece")).agg(
        F.max("all").alias("all"), F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    strings = stored(strings, "trie-ends")
    short = strings.where(F.col("all") <= LISTED).select(*NODE, F.sha2("ids", 256).alias("ends_sha256"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, done = None, None, []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * 4
            kinds = [pa.int64()] * 3 + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*NODE, "ends_sha256"])
        for batch in batches:
            for *now, ids in zip(*[batch.column(c).to_pylist() for c in (*NODE, "ids")]):
                if now != node:
                    if node is not None:
                        done.append((*node, sha.hexdigest()))
                    node, sha = now, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield out()
            done = []
        if node is not None:
            done.append((*node, sha.hexdigest()))
        yield out()

    long = strings.where(F.col("all") > LISTED).repartition(partitions(ends.sparkSession), *NODE) \
                  .sortWithinPartitions(*NODE, "piece").select(*NODE, "ids") \
                  .mapInArrow(stream, "depth bigint, a bigint, b bigint, ends_sha256 string")
    return short.unionByName(long)


def trie(said: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the conversations: conv_id (smallest
    member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves (childless nodes of its subtree, itself counted), saved_tokens
    (over its subtree, ``n_convs - 1`` times the bytes of each node's last text),
    ends_sha256 (of the ids of the members that end here), turn_id (of the last
    turn).

    ``said`` has conv, pos (from 1 without gaps), id, size; ``conversations`` has
    each conv once.  A conversation without turns is a member of the root alone.
    Equal conversations share all nodes.  No conversations give no rows.
    """
    spark = said.sparkSession
    blocks = _blocks(said)
    found = stored(_rolled(blocks, "count(*) AS n_convs, min(conv) AS conv_id"), "trie-nodes")
    root = conversations.groupBy().agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0")
    zero = F.lit(0).cast("bigint")
    root = root.select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), F.lit(None).cast("bigint").alias("pa"),
                       F.lit(None).cast("bigint").alias("pb"), zero.alias("size"), F.lit(None).cast("binary").alias("turn_id"), "n_convs", "conv_id")
    nodes = found.unionByName(root)
    below = found.groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(below, NODE, "left").na.fill(0, ["n_children"])
    nodes = nodes.withColumn("worth", (F.col("n_convs") - 1) * F.col("size"))
    nodes = stored(nodes.withColumn("leaf", F.when(F.col("n_children") == 0, 1).otherwise(0)), "trie-counted")

    # a conversation's credits: the nodes that it represents
    credits = nodes.groupBy(F.col("conv_id").alias("conv")).agg(F.sum("worth").alias("worth"), F.sum("leaf").alias("leaf")).where("worth > 0 or leaf > 0")
    credits = stored(credits, "trie-credits")
    weighed = _rolled(blocks.join(credits, "conv"), "sum(worth) AS below, sum(leaf) AS n_leaves").select(*NODE, "below", "n_leaves")
    every = credits.agg(F.sum("worth").alias("below"), F.sum("leaf").alias("n_leaves")).where("n_leaves > 0")
    weighed = weighed.unionByName(every.select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "below", "n_leaves"))
    # of the representative's own credits those above the node do not count
    above = _before(nodes.select(*NODE, "conv_id", "worth"), ["conv_id"], "depth", F.sum, {"worth": "above"}).select(*NODE, "above")

    # a conversation ends in its last block's last node, one without turns in the root
    last = blocks.groupBy("conv").agg(F.max(F.struct("last", "ea", "eb")).alias("e"))
    ends = conversations.join(last, "conv", "left").select(
        *[F.coalesce(F.col(f"e.{c}"), zero).alias(n) for c, n in zip(("last", "ea", "eb"), NODE)], "conv")
    lists = _lists(stored(ends, "trie-lasts"))

    parents = nodes.select((F.col("depth") + 1).alias("d"), F.col("a").alias("x"), F.col("b").alias("y"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(weighed, NODE).join(above, NODE).join(lists, NODE, "left")
    out = out.join(parents, (F.col("depth") == F.col("d")) & (F.col("pa") == F.col("x")) & (F.col("pb") == F.col("y")), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                      (F.col("below") - F.col("above")).alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"), "turn_id")
