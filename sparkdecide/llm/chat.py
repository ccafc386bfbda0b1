r"""Chat formatting over reply trees, with DataFrame functions only.

A message names the message that it replies to. Self-joins double the known
stretch of each message's ancestors until every stretch begins at a root, so a
tree of depth d takes about log2(d) joins. The leaves' stretches are the
root-to-leaf paths; they are ranked by score and each chosen one becomes one
conversation.

Template, by role::

    user        <s>[INST] text [/INST]
    assistant   (space) text</s>
    system      <<SYS>>text<</SYS>>
    any other   <<ROLE>>role<</ROLE>>text<</TURN>>

Inside texts and roles a backslash is doubled, and a control string gets a
backslash after its first character, so none can occur raw; ``unescaped`` takes
both away again.

Defined results: a null text is an empty text, a null role an empty role, a null
conversation id is an id of its own. A reply to a missing message starts a tree.
Messages that only reply to each other in a circle have no root and give no
path. Equal scores rank by leaf id. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

CONTROL = r"</?s>|\[/?INST\]|<</?(?:SYS|ROLE|TURN)>>"
_OPENING = r"([<\[])(?=/?s>|/?INST\]|</?(?:SYS|ROLE|TURN)>>)"
_TURN = r"(?s)<s>\[INST\] (.*?) \[/INST\]|<<SYS>>(.*?)<</SYS>>|<<ROLE>>(.*?)<</ROLE>>(.*?)<</TURN>>| (.*?)</s>"


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _OPENING, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def reply_paths(messages: DataFrame) -> DataFrame:
    """conv_id, leaf, path (message ids from root to leaf) of every leaf.

    messages: conv_id, node, parent (null at a root); node is unique in a conversation.
    """
    nodes = messages.select("conv_id", "node", "parent")
    known = nodes.select(F.col("conv_id").alias("c"), F.col("node").alias("up"))
    seg = nodes.join(known, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("up")), "left").select("conv_id", "node", "up", F.array("node").alias("path"))
    most = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while True:
        seg = materialize(seg, "segments")
        if reach >= most or seg.filter("up is not null").isEmpty():
            break
        done, a, b = seg.filter("up is null"), seg.filter("up is not null").alias("a"), seg.alias("b")
        seg = done.unionByName(a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.up") == F.col("b.node")), "left").select(
            "a.conv_id", "a.node", F.col("b.up").alias("up"), F.when(F.col("b.node").isNull(), F.col("a.path")).otherwise(F.concat("b.path", "a.path")).alias("path")
        ))
        reach *= 2
    replied = nodes.filter("parent is not null").select(F.col("conv_id").alias("c"), F.col("parent").alias("p")).distinct()
    leaves = seg.filter("up is null").join(replied, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("p")), "left_anti")
    return leaves.select("conv_id", F.col("node").alias("leaf"), "path")


def format_chats(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """conv_id, leaf, rank, formatted, loss (array of start and length in code points).

    messages: conv_id, node, parent, role, text, score (null: 0). ``branches``: how
    many paths of each conversation to keep, best mean score first; None keeps all.
    """
    rows = messages.select(
        "conv_id", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")
    )
    steps = reply_paths(rows).select("conv_id", "leaf", F.posexplode("path").alias("at", "step"))
    r = rows.select(F.col("conv_id").alias("c"), "node", "role", "text", "score")
    text, role = escaped(F.col("text")), escaped(F.col("role"))
    turns = steps.join(r, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("step") == F.col("node"))).select(
        "conv_id", "leaf", "at", "role", "score", text.alias("inside"),
        F.when(F.col("role") == "user", F.lit("<s>[INST] ")).when(F.col("role") == "assistant", F.lit(" ")).when(F.col("role") == "system", F.lit("<<SYS>>")).otherwise(F.concat(F.lit("<<ROLE>>"), role, F.lit("<</ROLE>>"))).alias("before"),
        F.when(F.col("role") == "user", F.lit(" [/INST]")).when(F.col("role") == "assistant", F.lit("</s>")).when(F.col("role") == "system", F.lit("<</SYS>>")).otherwise(F.lit("<</TURN>>")).alias("after"),
    ).withColumn("turn", F.concat("before", "inside", "after"))
    so_far = Window.partitionBy("conv_id", "leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.withColumn("start", F.sum(F.length("turn")).over(so_far) - F.length("turn") + F.length("before"))
    loss = F.when(F.col("role") == "assistant", F.struct(F.col("start").cast("long").alias("start"), F.length("inside").cast("long").alias("length")))
    chats = turns.groupBy("conv_id", "leaf").agg(
        F.avg("score").alias("score"), F.array_sort(F.collect_list(F.struct("at", "turn", loss.alias("loss")))).alias("turns")
    )
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "leaf"))
    chats = chats.select(
        "conv_id", "leaf", rank.alias("rank"), F.array_join(F.col("turns.turn"), "").alias("formatted"), F.filter(F.col("turns.loss"), lambda x: x.isNotNull()).alias("loss")
    )
    return chats if branches is None else chats.filter(F.col("rank") <= branches)


def read_chats(chats: DataFrame) -> DataFrame:
    """conv_id, leaf, turns (array of role and text), loss_text: what formatted chats say, parsed back."""

    def parsed(turn: Column) -> Column:
        group = lambda k: F.regexp_extract(turn, _TURN, k)
        role = F.when(turn.startswith("<s>[INST] "), F.lit("user")).when(turn.startswith("<<SYS>>"), F.lit("system")).when(turn.startswith("<<ROLE>>"), unescaped(group(3))).otherwise(F.lit("assistant"))
        return F.struct(role.alias("role"), unescaped(F.concat(*map(group, (1, 2, 4, 5)))).alias("text"))

    spans = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return chats.select(
        "conv_id", "leaf", "formatted", F.transform(F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(0)), parsed).alias("turns"), F.array_join(spans, "").alias("loss_text")
    )


def messages_by_turn(conversations: DataFrame) -> DataFrame:
    """Rows of conv_id, turn, role, text as messages, each a reply to the one before it.

    Rows of a conversation with equal turns follow each other by role, then text.
    """
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = conversations.select("conv_id", at.alias("node"), "role", "text")
    return rows.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
