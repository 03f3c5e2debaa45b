"""Chat formatting in budgeted windows, with DataFrame functions alone.

Prefix sums of turn tokens choose turn-aligned spans: a turn belongs to the span of ``room`` tokens in which it ends; a turn
that crosses into a span stays in it if the span's turns still fit, and stands alone otherwise. Every window repeats the
system turn and as much of the last ``history`` turns before its span as fits, and the loss mask leaves those out, so each
assistant text is a target once. Turns are never cut: one that doesn't fit is a window of its own, with the system turn.

The template is ``<s>[INST] role [/INST]text</s>`` for each turn. Control strings begin with ``<`` or ``[``; those and ``&``
are written as entities inside roles and texts, which is reversible, so no text can forge a mark.

A turn's tokens are by default the UTF-8 bytes of the formatted turn, marks and entities included: no byte-level or byte-fallback
tokenizer gives more, so the budget holds whatever the language. For fuller windows, ``tokens`` names a column with true counts of
``formatted_turn`` (rows without one fall back to the bytes), or is a function of role and text.

A conversation's digest needs its turns in one place, and so does a window sum: a conversation is a key that isn't split.

Defined cases: null texts and roles count as empty. Rows of a conversation stand by turn (null first), then role, then text;
repeated rows are turns of their own. Rows with a null conv_id form one conversation. The system turn is a first turn with
role ``system``; later system rows are turns like others. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, SHUT, END = "<s>[INST] ", " [/INST]", "</s>"
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def escape(text: Column) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def formatted_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role), F.lit(SHUT), escape(text), F.lit(END))


def most_tokens(role: Column, text: Column) -> Column:
    """The bytes of the formatted turn: no fewer than its tokens."""
    return F.octet_length(escape(role)) + F.octet_length(escape(text)) + len(OPEN + SHUT + END)


def spans(conversations: DataFrame, room: int, tokens=most_tokens) -> DataFrame:
    """One row for each turn: conv_id, pos, role, text, tokens, the sums before and up to it, its span, and the system turn."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    given = F.col(tokens) if isinstance(tokens, str) else F.lit(None)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), given.cast("bigint").alias("tokens"))
    count = most_tokens if isinstance(tokens, str) else tokens
    rows = rows.withColumn("tokens", F.coalesce("tokens", count(F.col("role"), F.col("text")).cast("bigint")))
    conv = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("pos", F.row_number().over(conv))
    upto = Window.partitionBy("conv_id").orderBy("pos")
    is_system = (F.col("pos") == 1) & (F.col("role") == "system")
    first = F.first(F.when(is_system, F.struct("text", "tokens")))
    rows = rows.withColumn("system", first.over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    own = F.when(is_system, F.lit(0)).otherwise(F.col("tokens"))
    rows = rows.withColumn("upto", F.sum(own).over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("before", F.col("upto") - own)
    free = F.greatest(F.lit(1), F.lit(room) - F.coalesce("system.tokens", F.lit(0)))
    rows = rows.withColumn("slot", F.floor((F.greatest(F.col("upto"), F.lit(1)) - 1) / free)).withColumn("free", free)
    slot = Window.partitionBy("conv_id", "slot")
    held = F.max("upto").over(slot) - F.min("before").over(slot)
    crossing = (F.floor(F.col("before") / F.col("free")) < F.col("slot")) & ~is_system
    rows = rows.withColumn("alone", crossing & (held > F.col("free")))
    return rows.withColumn("span", F.col("slot") * 2 + F.when(F.col("alone"), 0).otherwise(1)).drop("slot", "alone")


def windows(conversations: DataFrame, budget: int = 2048, history: int = 2, history_tokens: int = 512, tokens=most_tokens) -> DataFrame:
    """conv_id, window, formatted, n_repeated (turns at its start that are not new), loss_spans (start, length in characters)."""
    rows = spans(conversations, max(1, budget - history_tokens), tokens)
    upto = Window.partitionBy("conv_id").orderBy("pos")
    part = Window.partitionBy("conv_id", "span")
    size, begins = F.sum("tokens").over(part), F.min("pos").over(part)
    system_tokens = F.coalesce("system.tokens", F.lit(0))
    rows = rows.withColumn("begins", F.col("pos") == begins).withColumn("size", size)
    # What the window of a span may repeat: the rest of the budget, but no more than history_tokens.
    spare = F.least(F.lit(history_tokens), F.greatest(F.lit(0), F.lit(budget) - system_tokens - F.col("size")))
    rows = rows.withColumn("spare", spare)
    later = [
        F.when(
            F.lead("begins", h).over(upto) & (F.lead("before", h).over(upto) - F.col("before") <= F.lead("spare", h).over(upto)) & ~((F.col("pos") == 1) & (F.col("role") == "system")),
            F.struct(F.lead("span", h).over(upto).alias("span"), F.lit(1).alias("kind")),
        )
        for h in range(1, history + 1)
    ]
    used = F.array(F.struct(F.col("span"), F.lit(2).alias("kind")), *later)
    system_row = (F.col("begins") & F.col("system").isNotNull() & (F.col("pos") > 1)) & (F.lag("span").over(upto) != F.col("span"))
    piece = rows.select(
        "conv_id", "pos", "role", "text",
        F.concat(used, F.when(system_row, F.array(F.struct("span", F.lit(0).alias("kind")))).otherwise(F.array())).alias("used"),
        F.col("system.text").alias("system_text"),
    ).withColumn("used", F.explode(F.filter("used", lambda u: u.isNotNull())))
    kind, is_sys = F.col("used.kind"), F.col("used.kind") == 0
    role, text = F.when(is_sys, F.lit("system")).otherwise(F.col("role")), F.when(is_sys, F.col("system_text")).otherwise(F.col("text"))
    head, body = F.concat(F.lit(OPEN), escape(role), F.lit(SHUT)), escape(text)
    piece = piece.select(
        "conv_id", F.col("used.span").alias("window"),
        F.struct(
            kind.alias("kind"), F.when(is_sys, 0).otherwise(F.col("pos")).alias("pos"), F.concat(head, body, F.lit(END)).alias("out"),
            F.char_length(head).alias("skip"), F.when((kind == 2) & (F.col("role") == "assistant"), F.char_length(body)).alias("loss"),
        ).alias("p"),
    )
    got = piece.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("p")).alias("p"))  # turns of at most ``budget`` tokens, or one that is longer, and the system turn
    got = got.withColumn("n_repeated", F.size(F.filter("p", lambda x: x["kind"] < 2))).withColumn("sizes", F.transform("p", lambda x: F.char_length(x["out"])))
    starts = F.transform("p", lambda x, i: F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0), lambda a, b: a + b) + x["skip"])
    loss = F.filter(F.zip_with("p", starts, lambda x, s: F.struct(s.alias("start"), x["loss"].alias("length"))), lambda x: x["length"].isNotNull())
    return got.select("conv_id", "window", F.array_join(F.transform("p", lambda x: x["out"]), "").alias("formatted"), "n_repeated", loss.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from the windows alone."""
    turns = F.slice(F.split("formatted", END), F.col("n_repeated") + 1, F.greatest(F.lit(0), F.size(F.split("formatted", END)) - 1 - F.col("n_repeated")))

    def parsed(turn: Column) -> Column:
        at = F.instr(turn, SHUT) if isinstance(turn, str) else F.locate(SHUT, turn)
        role = F.substring(turn, F.lit(len(OPEN) + 1), at - 1 - len(OPEN))
        text = F.substring(turn, at + len(SHUT), F.char_length(turn))
        return F.concat(unescape(role), F.lit("\n"), unescape(text), F.lit("\n"))

    whole = F.col("formatted")
    targets = F.transform("loss_spans", lambda s: unescape(F.substring(whole, s["start"] + 1, s["length"])))
    rows = formatted.select(
        "conv_id", "window", F.size(turns).alias("n"), F.array_join(F.transform(turns, parsed), "").alias("turns"),
        F.array_join(targets, "").alias("loss"), F.char_length("formatted").alias("chars"),
    )
    ordered = lambda c: F.array_join(F.transform(F.col("all"), lambda x: x[c]), "")
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("all"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    return got.select(
        "conv_id", F.col("n_turns").cast("bigint").alias("n_turns"), F.sha2(ordered("turns"), 256).alias("turns_sha256"),
        F.char_length(ordered("loss")).cast("bigint").alias("loss_chars"), F.sha2(ordered("loss"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("bigint").alias("formatted_chars"),
    )
