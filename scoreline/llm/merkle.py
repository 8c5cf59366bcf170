"""Merkle manifest of a dataset by sibling-shift self-joins.

Every record has a leaf hash; the leaves of a group (a language, a source) stand
in the order of their ids, and runs of ``arity`` consecutive nodes are hashed
into their parent until one node, the group's subroot, remains.  The subroots,
in the order of their groups, are built into the root in the same way.

Each level is a table of nodes (group, index).  A node finds the others of its
run by an equijoin of the table with itself on a computed index: ``index XOR 1``
in a binary tree, otherwise one join for each slot offset.  The node in slot
zero then has the whole run and emits the parent.  A level is written once, so
levels do not pile up in one plan; all keys are unique, so no group is too large
for a task, and the levels shrink by ``arity`` each.

Proofs flow down the same tables: a node's path is its own siblings and its
parent's path, again an equijoin on unique keys.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreline.llm.common import partitions, plain, stored
from scoreline.operators.numbering import number_rows

#: nodes of a level that share a task
TASK_NODES = 50_000


def field(value: Column) -> Column:
    """A value as hash input: ``-`` if null, else its UTF-8 byte count, ``:`` and
    itself.  No two lists of values have the same concatenation."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def record_hash(*values: Column | str) -> Column:
    """SHA-256 of the fields of a record (columns or their names), as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field(plain(v) if isinstance(v, str) else v) for v in values]), 256))


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _step(slot: Column, others: list[Column]) -> Column:
    """One level of a path: the own slot as one byte, then the digests of the
    run's other nodes in order."""
    return F.concat(F.unhex(F.lpad(F.hex(slot), 2, "0")), *[F.coalesce(o, F.lit(b"")) for o in others])


def _level(nodes: DataFrame, arity: int, label: str, tasks: int) -> DataFrame:
    """``nodes`` (grp, idx, m, h) with ``step``, the siblings of each node, and
    ``parent``: the run's hash on slot-zero rows, the subroot on a group's last node."""
    slot = F.pmod(F.col("idx"), F.lit(arity))
    if arity == 2:
        wanted = [F.col("idx").bitwiseXOR(F.lit(1).cast("bigint"))]
    else:
        wanted = [F.col("idx") - slot + F.pmod(slot + shift, F.lit(arity)) for shift in range(1, arity)]
    rows = nodes.select("grp", "idx", "m", "h", *[w.alias(f"want{i}") for i, w in enumerate(wanted)])
    for i in range(len(wanted)):
        shifted = nodes.select(F.col("grp").alias("g"), F.col("idx").alias("at"), F.col("h").alias(f"h{i}"))
        rows = rows.join(shifted, (F.col("grp") == F.col("g")) & (F.col(f"want{i}") == F.col("at")), "left").drop("g", "at")
    others = [F.col("h0")]
    if arity > 2:
        # the last shifts wrap round to the run's start: bring the nodes into their order
        found = [F.struct(F.col(f"want{i}").alias("at"), F.col(f"h{i}").alias("h")) for i in range(len(wanted))]
        in_order = F.array_sort(F.filter(F.array(*found), lambda x: x["h"].isNotNull()))
        others = [F.get(in_order, F.lit(i))["h"] for i in range(len(wanted))]
    run = F.concat(hex_of(F.col("h")), *[F.coalesce(hex_of(o), F.lit("")) for o in others])
    lone = F.col("m") == 1
    done = rows.select("grp", "idx", "m", F.when(~lone, _step(slot, others)).alias("step"),
                       F.when(lone, F.col("h")).when(slot == 0, F.unhex(F.sha2(run, 256))).alias("parent"))
    return stored(done.coalesce(tasks), label)


def _climb(leaves: DataFrame, arity: int, tasks: int, label: str) -> list[DataFrame]:
    """The levels above ``leaves`` (grp, idx, m, h), bottom first.  A row of m = 1
    is a finished group; its ``parent`` is the subroot."""
    size = leaves.agg(F.max("m").alias("most"), F.count("*").alias("n"), F.count(F.when(F.col("idx") == 0, 1)).alias("groups")).first()
    most, n = size.most or 0, size.n
    levels, nodes = [], leaves
    while most > 0:
        level = _level(nodes, arity, f"{label}-{len(levels)}", max(1, min(tasks, math.ceil(n / TASK_NODES))))
        levels.append(level)
        if most == 1:
            break
        nodes = level.where(f"m > 1 and idx % {arity} = 0").select(
            "grp", F.expr(f"idx div {arity}").alias("idx"), F.expr(f"(m + {arity - 1}) div {arity}").alias("m"), F.col("parent").alias("h"))
        most, n = math.ceil(most / arity), math.ceil(n / arity) + size.groups
    return levels


def _descend(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """Every leaf (grp, idx) of ``levels`` with its ``path``, the steps from the
    bottom up, ended by that of its group in ``tops`` (grp, lvl, path, subroot),
    where lvl is the level at which the group was finished."""
    def finished(k: int) -> DataFrame:
        return tops.where(F.col("lvl") == k).select("grp", F.lit(0).cast("bigint").alias("idx"), "path", "subroot")

    above = None
    for k in reversed(range(len(levels))):
        here = finished(k)
        if above is not None:
            up = above.select(F.col("grp").alias("g"), F.col("idx").alias("up"), "path", "subroot")
            own = levels[k].where("m > 1").select("grp", "idx", "step")
            joined = own.join(up, (F.col("grp") == F.col("g")) & (F.expr(f"idx div {arity}") == F.col("up")))
            here = here.unionByName(joined.select("grp", "idx", F.concat(F.array("step"), "path").alias("path"), "subroot"))
        above = here
    return above


def manifest(records: DataFrame, leaf: Column, id_col: str, group_col: str, arity: int = 2) -> DataFrame:
    """Every row of ``records`` with all its columns and: ``leaf`` (its hash),
    ``subroot`` (of its group), ``root`` (of all) as lowercase hex, and ``path``
    (see ``proof_hash`` and ``fold``), enough to check the row by itself.

    ``leaf`` is a binary column of 32 bytes, as of ``record_hash``.  Leaves
    ascend by id inside their group, null ids first, rows of one id by their
    hash; groups ascend bytewise, null first.  A run cut short by the end of its
    level, of one node too, is hashed like any other; a lone leaf is its
    group's subroot, a lone subroot the root.  Equal rows are leaves each.  No
    records give no rows.  Columns called like the new ones are replaced.
    """
    spark = records.sparkSession
    new = ("leaf", "subroot", "root", "path")
    keep = [c for c in records.columns if c.lower() not in new]
    group = plain(group_col).cast("string")
    rows = stored(records.select(F.struct(*map(plain, keep)).alias("row"), plain(id_col).alias("id"),
                                 # null first, then bytewise
                                 F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group)).alias("grp"),
                                 leaf.alias("h"), F.monotonically_increasing_id().alias("uid")), "merkle-leaves")
    tasks = partitions(spark)
    rows = number_rows(rows, [F.col("id").asc_nulls_first(), F.col("h"), F.col("uid")], ["grp"], "idx", total="m")
    rows = stored(rows.withColumn("idx", F.col("idx") - 1), "merkle-ordered")
    levels = _climb(rows.select("grp", "idx", "m", "h"), arity, tasks, "merkle-level")
    if not levels:
        return rows.select("row.*", *[F.lit(None).cast("string").alias(c) for c in new[:3]],
                           F.lit(None).cast("array<binary>").alias("path"))
    subroots = reduce(DataFrame.unionByName, [
        level.where("m = 1").select("grp", F.lit(k).alias("lvl"), F.col("parent").alias("h")) for k, level in enumerate(levels)])
    subroots = stored(subroots, "merkle-subroots")
    ordered = number_rows(subroots, [F.col("grp")], name="idx").withColumn("idx", F.col("idx") - 1)
    count = ordered.count()
    ordered = stored(ordered.withColumn("m", F.lit(count).cast("bigint")), "merkle-tops")
    top = _climb(ordered.select(F.lit("").alias("grp"), "idx", "m", "h"), arity, tasks, "merkle-top")
    root = bytes(top[-1].where("m = 1").first().parent).hex()
    peak = spark.createDataFrame([("", len(top) - 1, [], root)], "grp string, lvl int, path array<binary>, subroot string")
    ends = _descend(top, peak, arity).select("idx", "path")
    tops = stored(ordered.join(ends, "idx").select("grp", "lvl", "path", hex_of(F.col("h")).alias("subroot")), "merkle-paths")
    paths = _descend(levels, tops, arity).select(F.col("grp").alias("g"), F.col("idx").alias("i"), "path", "subroot")
    return rows.join(paths, (F.col("grp") == F.col("g")) & (F.col("idx") == F.col("i"))).select(
        "row.*", hex_of(F.col("h")).alias("leaf"), "subroot", F.lit(root).alias("root"), "path")


def proof(path: Column) -> Column:
    """The steps of a path, bottom first: own slot in the run, and the hex digests
    of the run's others, left to right."""
    def step(s: Column) -> Column:
        rest = F.substring(hex_of(s), F.lit(3), F.octet_length(s) * 2)
        starts = F.when(F.octet_length(s) > 1, F.sequence(F.lit(1), F.length(rest) - 63, F.lit(64))).otherwise(F.array().cast("array<int>"))
        return F.struct(F.conv(F.hex(F.substring(s, 1, 1)), 16, 10).cast("int").alias("slot"),
                        F.transform(starts, lambda i: F.substring(rest, i, F.lit(64))).alias("others"))
    return F.transform(path, step)


def proof_hash(path: Column) -> Column:
    """SHA-256 of all siblings' hex digests, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.substring(hex_of(s), F.lit(3), F.octet_length(s) * 2)), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` (hex) and the siblings of ``path`` give."""
    def up(acc: Column, s: Column) -> Column:
        rest = F.substring(hex_of(s), F.lit(3), F.octet_length(s) * 2)
        before = F.conv(F.hex(F.substring(s, 1, 1)), 16, 10).cast("int") * 64
        return F.sha2(F.concat(F.substring(rest, F.lit(1), before), acc, F.substring(rest, before + 1, F.length(rest))), 256)
    return F.aggregate(path, leaf, up)
