"""Reply trees to training conversations, all in DataFrame operations.

``reply_paths`` enumerates root-to-leaf paths of reply trees by iterative self-joins. Each pass joins the table of
jump pointers with itself, which doubles their reach, so a tree of depth d takes about log2(d) passes and every
table has as many rows as there are messages. All joins are sort-merge joins: ids compress so well that a table's files look
small enough for a broadcast when its rows are not, and the driver would hold them. Branches are ranked by the sum of their messages' scores and the
best ``top`` of each tree are chosen; ``format_paths`` writes each chosen path as one conversation.

Template: ``<|im_start|>role LF text<|im_end|> LF`` for each turn. In texts and roles ``\\`` becomes ``\\\\`` and
``<|`` becomes ``<\\|``; in roles LF becomes ``<\\n>``. ``read_back`` undoes this exactly.

Null texts and roles count as empty, null scores as 0. A message whose parent is missing is a root. Messages on or
below a cycle of replies become roots of their own. Ties between branches go to the smaller leaf id. Repeated
(id) rows: the smallest by all columns is taken. Empty tables give no conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import Scratch

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("<\\n>"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("<\\n>"), F.lit("\n")))


def _jump(scratch: Scratch, level: DataFrame, n: int) -> tuple[list[DataFrame], DataFrame]:
    """All levels of jump pointers (id, up, top, dist, total) and the rows that never reach a root.

    up is the message 2^level steps above, or null past the root; top is the highest message known to be above;
    total sums the scores from the message to the one below up, or to the root.
    """
    levels = [level]
    for _ in range(max(1, n).bit_length() + 1):
        open_rows = levels[-1].where(F.col("up").isNotNull())
        if open_rows.isEmpty():
            break
        far = levels[-1].select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"), F.col("dist").alias("dist2"), F.col("total").alias("total2"))
        step = open_rows.join(far.hint("merge"), "up", "left").select("id", F.col("up2").alias("up"), F.col("top2").alias("top"), (F.col("dist") + F.col("dist2")).alias("dist"), (F.col("total") + F.col("total2")).alias("total"))
        done = levels[-1].where(F.col("up").isNull())
        levels.append(scratch.save(step.unionByName(done)))
    return levels, levels[-1].where(F.col("up").isNotNull())


def _first_level(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "up", F.coalesce("up", "id").alias("top"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("dist"), "total")


def reply_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(root, leaf, rank, depth, id) of the messages on the ``top`` best branches of every reply tree.

    ``messages``: id, parent_id, score. depth counts from 0 at the root; rank from 1 at the best branch.
    """
    spark = messages.sparkSession
    scratch = Scratch(spark, "replies")
    nodes = messages.groupBy("id").agg(F.min(F.struct("parent_id", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))).alias("m")).where(F.col("id").isNotNull()).select("id", "m.*")
    known = nodes.select(F.col("id").alias("parent_id"), F.lit(True).alias("known"))
    # roots stay out of the join: their null parents would all meet in one task
    replies = nodes.where(F.col("parent_id").isNotNull()).join(known.hint("merge"), "parent_id", "left").select("id", F.when(F.col("known"), F.col("parent_id")).alias("up"), F.col("score").alias("total"))
    roots = nodes.where(F.col("parent_id").isNull()).select("id", F.col("parent_id").alias("up"), F.col("score").alias("total"))
    nodes = replies.unionByName(roots)
    nodes = scratch.save(_first_level(nodes))
    n = nodes.count()
    levels, stuck = _jump(scratch, nodes, n)
    if not stuck.isEmpty():
        cut = stuck.select("id", F.lit(True).alias("cut"))
        nodes = nodes.join(cut.hint("merge"), "id", "left").select("id", F.when(F.col("cut").isNull(), F.col("up")).alias("up"), "total")
        levels, _ = _jump(scratch, scratch.save(_first_level(nodes)), n)
    depths = levels[-1].select("id", F.col("top").alias("root"), F.col("dist").alias("depth"), "total")
    parents = levels[0].where(F.col("up").isNotNull()).select(F.col("up").alias("id")).distinct()
    leaves = depths.join(parents.hint("merge"), "id", "left_anti")
    rank = F.row_number().over(W.partitionBy("root").orderBy(F.desc("total"), "id"))
    chosen = scratch.save(leaves.withColumn("rank", rank).where(F.col("rank") <= top).select("root", F.col("id").alias("leaf"), "rank"))
    # the ancestors of a chosen leaf: the set doubles along with the reach of the pointers
    members = chosen.select("leaf", F.col("leaf").alias("id"))
    for level in reversed(levels):
        both = F.explode(F.array_compact(F.array("id", "up")))
        members = members.join(level.select("id", "up").hint("merge"), "id").select("leaf", both.alias("id"))
    paths = members.join(depths.select("id", "depth").hint("merge"), "id")
    return paths.join(chosen.hint("merge"), "leaf").select("root", "leaf", "rank", "depth", "id")


def format_paths(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """(root, leaf, rank, formatted, loss_spans): one conversation per chosen path.

    ``messages``: id, role, text. loss_spans holds (start, length) in code points of what the assistant wrote.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = messages.groupBy("id").agg(F.min(F.struct(role.alias("role"), text.alias("text"))).alias("m")).select(
        "id", (F.col("m.role") == "assistant").alias("loss"), escape_role(F.col("m.role")).alias("role"), escape(F.col("m.text")).alias("body")
    )
    turn = turn.select("id", "loss", F.concat(F.lit(START), "role", F.lit("\n")).alias("head"), "body")
    rows = paths.join(turn.hint("merge"), "id")
    before = W.partitionBy("leaf").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END)
    rows = rows.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    parts = F.array_sort(F.collect_list(F.struct("depth", F.concat("head", "body", F.lit(END)).alias("turn"), "loss", F.struct("start", F.length("body").cast("long").alias("length")).alias("span"))))
    out = rows.groupBy("leaf").agg(F.first("root").alias("root"), F.first("rank").alias("rank"), parts.alias("parts"))
    return out.select(
        "root", "leaf", "rank",
        F.array_join(F.transform("parts", lambda p: p["turn"]), "").alias("formatted"),
        F.transform(F.filter("parts", lambda p: p["loss"]), lambda p: p["span"]).alias("loss_spans"),
    )


def read_back(df: DataFrame) -> DataFrame:
    """Adds turns (array of role, text) and loss_text, read from formatted and loss_spans."""
    pieces = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda p: p != "")  # only the first piece is empty

    def turn(p: Column) -> Column:
        at = F.position(F.lit("\n"), p)
        text = F.substr(p, at + 1, F.length(p) - at - len(END))
        return F.struct(unescape_role(F.substr(p, F.lit(1), at - 1)).alias("role"), unescape(text).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return df.withColumn("turns", F.transform(pieces, turn)).withColumn("loss_text", F.array_join(loss, ""))
