"""Chat formatting in budgeted windows, with DataFrame functions only.

Template: `<|im_start|>role\\ntext<|im_end|>\\n` per turn.  Inside roles and texts `&` is written
`&amp;` and `<|` is written `&lt;|` (in roles a line feed also becomes `&#10;`), so control strings
can come from the template alone and reading back is exact.

Windows come from prefix sums of turn tokens.  Prefix sums have two levels, (conversation, block of
256 turn numbers) and turns within a block, so that a conversation with a third of all rows is spread
over many tasks.  With `room` = budget - history - system tokens, a turn falls in the bucket of its
start prefix; where a bucket's last turn would exceed the room it becomes a window of its own.  A
window thus holds at most `room` new tokens, or one single turn that is longer than that.  Each window
repeats the system turn and the turns before it that fit in `history` tokens whole; repeated turns are never
under the loss mask, so each assistant text is a target exactly once.  A system turn that takes more than half of
budget - history would leave no room for new turns: it stands in its place like any other turn and is not repeated by force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

START, END = "<|im_start|>", "<|im_end|>\n"
BLOCK = 256


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&#10;"), F.lit("\n")), F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def default_tokens(text: Column) -> Column:
    """Budget tokens of a text: a fourth of its UTF-8 bytes, at least one."""
    return F.greatest(F.ceil(F.octet_length(text) / 4), F.lit(1)).cast("long")


def prefix_sums(turns: DataFrame) -> DataFrame:
    """turns (conv, turn, ord, n, ...) plus `start`: the sum of n over the conversation's earlier turns."""
    turns = turns.withColumn("blk", F.floor(F.col("turn") / BLOCK))
    sums = turns.groupBy("conv", "blk").agg(F.sum("n").alias("bn"))
    before = W.partitionBy("conv").orderBy("blk").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("conv").alias("c2"), F.col("blk").alias("b2"), F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("base"))
    inner = W.partitionBy("conv", "blk").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    turns = turns.withColumn("inner_start", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    joined = turns.join(sums, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("blk") == F.col("b2")))
    return joined.withColumn("start", F.col("base") + F.col("inner_start")).drop("c2", "b2", "base", "inner_start", "blk")


def windows(conversations: DataFrame, budget: int = 2048, history: int = 256, tokens=default_tokens) -> DataFrame:
    """Rows (conv_id, window, formatted, loss_spans, n_turns, n_repeated, n_tokens).

    window: the prefix sum at which the window's new turns begin.  loss_spans: array of (start, length)
    in characters of `formatted`, from 0, of the escaped assistant texts that are targets.
    n_repeated: how many turns at the head of the window were shown before.

    Null roles and texts read as empty; a null conv_id is a conversation of its own; turns are ordered
    by turn (null first), ties by role and text; repeated rows are turns of their own; other columns
    are ignored; an empty table gives no windows; a text of any length stays whole.

    Placement runs on light columns; texts move twice, to their places and to their windows.
    """
    raw = conversations.select(F.col("conv_id").alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(-(2**40))).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("rid"))
    raw = materialise(raw, "chat-turns")
    seg = F.concat(F.lit(START), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("&#10;")), F.lit("\n"), escaped(F.col("text")), F.lit(END))
    light = raw.select("conv", "turn", "role", "rid", F.struct("turn", "role", F.xxhash64("text"), "rid").alias("ord"), tokens(seg).alias("n"), F.length(seg).alias("seg_len"), F.length(escaped(F.col("text"))).alias("body_len"))
    heads = light.groupBy("conv").agg(F.min_by(F.struct("role", "ord", "seg_len", "n", "rid"), "ord").alias("head"))
    heads = heads.select(F.col("conv").alias("hc"), F.when((F.col("head.role") == "system") & (F.col("head.n") <= (budget - history) // 2), F.col("head")).alias("sys"))
    turns = prefix_sums(light).join(heads, F.col("conv").eqNullSafe(F.col("hc"))).drop("hc")
    room = F.greatest(F.lit(budget - history) - F.coalesce("sys.n", F.lit(0)), F.lit(1))
    turns = turns.withColumn("room", room).withColumn("k", F.floor(F.col("start") / F.col("room")))
    first = turns.groupBy("conv", "k").agg(F.min("start").alias("s0")).select(F.col("conv").alias("c2"), F.col("k").alias("k2"), "s0")
    placed = turns.join(first, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("k") == F.col("k2"))).drop("c2", "k2")
    alone = (F.col("start") > F.col("s0")) & (F.col("start") + F.col("n") - F.col("s0") > F.col("room"))
    placed = placed.withColumn("s", F.when(alone, F.col("start")).otherwise(F.col("s0")))
    placed = materialise(placed.select("conv", "role", "rid", "ord", "n", "seg_len", "body_len", "sys", "room", "k", "start", "s"), "chat-placed")
    # a turn is history of the windows that begin within `history` tokens of its start
    begun = placed.groupBy("conv", "k", "s").agg(F.first("sys").alias("ws")).select(F.col("conv").alias("c2"), F.col("k").alias("k2"), F.col("s").alias("s2"), "ws")
    reach = placed.select("conv", "rid", "ord", "n", "seg_len", "start", "s", F.explode(F.sequence("k", F.floor((F.col("start") + history) / F.col("room")))).alias("k3"))
    old = reach.join(begun, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("k3") == F.col("k2")) & (F.col("s2") > F.col("s")) & (F.col("s2") - F.col("start") <= history))
    old = old.where(F.col("ws").isNull() | (F.col("rid") != F.col("ws.rid")))
    again = begun.where("ws is not null and s2 > 0")
    no = F.lit(0)
    rows = placed.select("conv", "s", "ord", "rid", "n", "seg_len", F.when(F.col("role") == "assistant", F.col("body_len")).alias("body"), F.lit(2).alias("part"))
    rows = rows.unionByName(old.select("conv", F.col("s2").alias("s"), "ord", "rid", "n", "seg_len", F.lit(None).cast("int").alias("body"), F.lit(1).alias("part")))
    rows = rows.unionByName(again.select(F.col("c2").alias("conv"), F.col("s2").alias("s"), F.col("ws.ord").alias("ord"), F.col("ws.rid").alias("rid"), F.col("ws.n").alias("n"), F.col("ws.seg_len").alias("seg_len"), F.lit(None).cast("int").alias("body"), no.alias("part")))
    earlier = W.partitionBy("conv", "s").orderBy("part", "ord").rowsBetween(W.unboundedPreceding, -1)
    at = F.coalesce(F.sum("seg_len").over(earlier), no)
    span = F.when(F.col("body").isNotNull(), F.struct((at + F.col("seg_len") - len(END) - F.col("body")).alias("start"), F.col("body").cast("long").alias("length")))
    rows = rows.select("conv", "s", "part", "ord", "rid", "n", span.alias("span"))
    rows = rows.join(raw.select("rid", seg.alias("seg")), "rid")
    grouped = rows.groupBy("conv", "s").agg(F.sort_array(F.collect_list(F.struct("part", "ord", "seg", "span"))).alias("all"), F.sum("n").alias("n_tokens"), F.sum((F.col("part") < 2).cast("int")).cast("int").alias("n_repeated"))
    spans = F.filter(F.transform("all", lambda x: x["span"]), lambda x: x.isNotNull())
    text = F.array_join(F.transform("all", lambda x: x["seg"]), "")
    return grouped.select(F.col("conv").alias("conv_id"), F.col("s").alias("window"), text.alias("formatted"), spans.alias("loss_spans"), F.size("all").alias("n_turns"), "n_repeated", "n_tokens")


def read_back(formatted: DataFrame) -> DataFrame:
    """From windows(): per conversation the digests of its turns and of all text under the mask.

    A digest of a whole conversation needs that conversation's text in one row."""
    segs = F.split("formatted", r"<\|im_start\|>")  # the first piece is empty
    fresh = F.slice(segs, F.col("n_repeated") + 2, F.size(segs))
    turns = F.transform(fresh, lambda x: F.concat(unescaped(F.substring(x, F.lit(1), F.length(x) - len(END))), F.lit("\n")))
    loss = F.transform("loss_spans", lambda x: unescaped(F.substring(F.col("formatted"), x["start"].cast("int") + 1, x["length"].cast("int"))))
    rows = formatted.select("conv_id", F.struct("window", F.array_join(turns, "").alias("t"), F.array_join(loss, "").alias("l")).alias("w"), F.size(turns).alias("n"), F.length("formatted").alias("c"))
    one = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("ws"), F.sum("n").cast("long").alias("n_turns"), F.sum("c").cast("long").alias("formatted_chars"))
    every = F.array_join(F.transform("ws", lambda w: w["t"]), "")
    lost = F.array_join(F.transform("ws", lambda w: w["l"]), "")
    return one.select("conv_id", "n_turns", F.sha2(every, 256).alias("turns_sha256"), F.length(lost).cast("long").alias("loss_chars"), F.sha2(lost, 256).alias("loss_sha256"), "formatted_chars")
