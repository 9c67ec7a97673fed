"""Chat formatting in budgeted windows, with DataFrame functions only.

Running sums of turn tokens place every turn on a token axis which is cut into slices of the budget. Turns inside one
slice form a span, a turn that crosses a cut starts the next one, and a crossing turn is joined with the turns of its
slice where both fit. So spans are turn-aligned, never above the budget unless a single turn is, and they are found
without walking a conversation. Each span becomes one window: the system turn again, a few turns of history again,
then the new turns. Only the new assistant turns are targets: repeated ones are masked.

Template: ``<turn ROLE>\\nTEXT</turn>\\n``. Inside texts and roles a backslash becomes ``\\b``, ``</turn>`` becomes
``\\e`` and ``<turn `` becomes ``\\s``; in roles ``>`` becomes ``\\g`` as well. Every backslash of the output starts an
escape, so reading back is exact for any text.

Nulls and edge cases: a null text or role is empty; a null conversation id is an id like any other; a null turn number
comes first; equal turn numbers follow in order of role and text, and equal rows stay repeated; very long turns are
kept whole, alone in their window; an empty table gives no windows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import let, settled

#: Tokens that the marks of a turn count for.
TURN_TOKENS = 4


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(text, F.lit("</turn>"), F.lit("\\e")), F.lit("<turn "), F.lit("\\s"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\s"), F.lit("<turn ")), F.lit("\\e"), F.lit("</turn>"))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\g"), F.lit(">")), F.lit("\\n"), F.lit("\n")))


def rough_tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up; any other count may be passed in its place."""
    return F.ceil(F.octet_length(text) / 4)


def place_turns(conversations: DataFrame, budget: int, history: int, history_tokens: int, tokens=rough_tokens) -> DataFrame:
    """Turns with their position, tokens and span.

    Positions and running token counts come from two levels of sums (blocks of turn numbers, then turns inside a
    block), so a conversation with very many turns is not one sorted group.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.select(
        F.col("conv_id").alias("conv"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"),
        F.coalesce(F.floor(F.col("turn") / 256), F.lit(-(2 ** 62))).cast("long").alias("block"))
    turns = settled(turns.withColumn("tokens", tokens(F.col("text")).cast("long") + TURN_TOKENS), "turns")
    key = Window.partitionBy("conv")
    blocks = turns.groupBy("conv", "block").agg(F.count("*").alias("rows"), F.sum("tokens").alias("sum"))
    before = key.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
                           F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("sum_before"))
    on = turns["conv"].eqNullSafe(blocks["conv"]) & (turns["block"] == blocks["block"])
    turns = turns.join(blocks, on).select(turns["*"], "rows_before", "sum_before")
    inside = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    pos = F.col("rows_before") + F.row_number().over(inside) - 1
    end = F.col("sum_before") + F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    turns = turns.select("conv", "role", "text", "tokens", pos.alias("pos"), (end - F.col("tokens")).alias("start"))
    first = turns.filter("pos = 0 and role = 'system'").select(
        F.col("conv").alias("sys_conv"), F.col("text").alias("sys_text"), F.col("tokens").alias("sys_tokens"))
    turns = turns.join(first, turns["conv"].eqNullSafe(first["sys_conv"]) & F.lit(True), "left").drop("sys_conv")
    room = F.greatest(F.lit(budget - history_tokens * (history > 0)) - F.coalesce("sys_tokens", F.lit(0)), F.lit(1))
    is_system = (F.col("pos") == 0) & F.col("sys_text").isNotNull()
    slice_of = lambda at: F.floor(at / F.col("room"))
    turns = turns.filter(~is_system | F.col("sys_text").isNull()).withColumn("room", room)
    turns = turns.withColumn("start", F.col("start") - F.coalesce("sys_tokens", F.lit(0)))
    last = F.col("start") + F.col("tokens") - 1
    return turns.select("*", slice_of(last).alias("slice"), (slice_of(F.col("start")) < slice_of(last)).alias("crosses"))


def span_turns(turns: DataFrame) -> DataFrame:
    """Adds ``span``: the position of the span's first turn."""
    pieces = turns.groupBy("conv", "slice", "crosses").agg(F.min("pos").alias("first"), F.sum("tokens").alias("sum"), F.first("room").alias("room"))
    both = pieces.groupBy("conv", "slice").agg(
        F.min("first").alias("all_first"), F.min(F.when(~F.col("crosses"), F.col("first"))).alias("inner_first"),
        F.sum("sum").alias("all_sum"), F.first("room").alias("room"))
    joined = F.col("all_sum") <= F.col("room")
    both = both.select(F.col("conv").alias("b_conv"), F.col("slice").alias("b_slice"), "all_first", F.when(joined, F.col("all_first")).otherwise(F.col("inner_first")).alias("inner_first"))
    on = turns["conv"].eqNullSafe(both["b_conv"]) & (turns["slice"] == both["b_slice"])
    span = F.when(F.col("crosses"), F.col("all_first")).otherwise(F.col("inner_first"))
    return turns.join(both, on).withColumn("span", span).drop("b_conv", "b_slice", "all_first", "inner_first")


def format_windows(conversations: DataFrame, budget: int = 512, history: int = 2, history_tokens: int = 128, tokens=rough_tokens) -> DataFrame:
    """One row per window: conv_id, window (position of its first new turn), n_repeated, text, targets.

    ``n_repeated`` leading turns of the window repeat earlier ones. ``targets`` are (start, length) in code points of
    the escaped texts under the loss mask. A conversation of only a system turn gives one window with that turn as new.
    """
    turns = settled(span_turns(place_turns(conversations, budget, history, history_tokens, tokens)), "spans")
    body = turns.select("conv", F.col("span").alias("window"), "pos", "role", "text", F.lit(True).alias("new"))
    if history:
        starts = turns.select(F.col("conv").alias("s_conv"), F.col("span").alias("window")).distinct()
        asked = starts.select("s_conv", "window", F.explode(F.array(*[F.lit(i) for i in range(1, history + 1)])).alias("back"))
        asked = asked.withColumn("s_pos", F.col("window") - F.col("back"))
        seen = turns.join(asked, turns["conv"].eqNullSafe(asked["s_conv"]) & (turns["pos"] == asked["s_pos"]))
        used = F.sum("tokens").over(Window.partitionBy("conv", "window").orderBy("back"))
        seen = seen.withColumn("used", used).filter(F.col("used") <= history_tokens)
        body = body.unionByName(seen.select("conv", "window", "pos", "role", "text", F.lit(False).alias("new")))
    windows = body.groupBy("conv", "window").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text", "new"))).alias("turns"))
    heads = conversations_heads(conversations)
    windows = (heads.join(windows, heads["h_conv"].eqNullSafe(windows["conv"]), "left")
               .select(F.col("h_conv").alias("conv_id"), "h_text", F.coalesce("window", F.lit(0)).alias("window"), "turns"))
    sys_new = F.col("turns").isNull() | F.exists(F.col("turns"), lambda t: t["pos"] == 1)
    head = F.when(F.col("h_text").isNotNull(), F.array(F.struct(
        F.lit(0).cast("long").alias("pos"), F.lit("system").alias("role"), F.col("h_text").alias("text"), (sys_new & ~F.exists(F.coalesce("turns", F.array().cast(
            "array<struct<pos:bigint,role:string,text:string,new:boolean>>")), lambda t: (t["pos"] == 1) & ~t["new"])).alias("new"))))
    kind = "array<struct<pos:bigint,role:string,text:string,new:boolean>>"
    all_turns = F.concat(F.coalesce(head, F.array().cast(kind)).cast(kind), F.coalesce("turns", F.array().cast(kind)).cast(kind))
    # a system turn that is new goes first in any case, so the repeated turns are a prefix but for it
    marked = F.transform(all_turns, lambda t: F.struct(
        t["new"].alias("new"), (t["new"] & (t["role"] == "assistant")).alias("target"),
        F.concat(F.lit("<turn "), escape_role(t["role"]), F.lit(">\n")).alias("open"), escape(t["text"]).alias("body")))

    def assemble(parts):
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

        def step(acc, t):
            start = acc["at"] + F.length(t["open"])
            span = F.array(F.struct(start.cast("long").alias("start"), F.length(t["body"]).cast("long").alias("length")))
            return F.struct((start + F.length(t["body"]) + len("</turn>\n")).cast("long").alias("at"), F.when(t["target"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        text = F.array_join(F.transform(parts, lambda t: F.concat(t["open"], t["body"], F.lit("</turn>\n"))), "")
        return F.struct(text.alias("text"), F.aggregate(parts, zero, step, lambda acc: acc["spans"]).alias("targets"), F.size(F.filter(parts, lambda t: ~t["new"])).alias("n_repeated"))

    done = windows.select("conv_id", "window", let(marked, assemble).alias("w"))
    return done.select("conv_id", "window", F.col("w.n_repeated").alias("n_repeated"), F.col("w.text").alias("text"), F.col("w.targets").alias("targets"))


def conversations_heads(conversations: DataFrame) -> DataFrame:
    """(h_conv, h_text): every conversation, with the text of its first turn if that is a system turn."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"), role.alias("role"), text.alias("text"))
    first = conversations.groupBy(F.col("conv_id").alias("h_conv")).agg(F.min(order).alias("m"))
    return first.select("h_conv", F.when(F.col("m.role") == "system", F.col("m.text")).alias("h_text"))


def read_window(text: Column) -> Column:
    """Turns (role, text) of a formatted window, unescaped."""
    parts = F.filter(F.split(text, "</turn>\n", -1), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        unescape_role(F.substring(p, F.lit(7), F.instr(p, ">\n") - 7)).alias("role"),
        unescape(F.substring(p, F.instr(p, ">\n") + 2, F.length(p))).alias("text")))


def read_targets(text: Column, targets: Column) -> Column:
    """Texts under the loss mask, unescaped, in order."""
    return F.transform(targets, lambda s: unescape(F.substring(text, s["start"].cast("int") + 1, s["length"].cast("int"))))
