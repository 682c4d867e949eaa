"""Chat formatting in budgeted windows.

A conversation's turns stand in the order of (turn, role, text). Its windows are turn-aligned spans that prefix sums of turn
tokens choose: with N = new_tokens, a turn of more than N / 2 tokens is a window of its own, and the others belong to the
window in whose half-budget cell their prefix sum starts, so that a window's new turns have N tokens at most (unless one
turn alone has more). Every window repeats the conversation's system turn (its first turn, if the role is system) and then
at most ``history`` of the turns just before it, as far as they have ``history_tokens`` together. Of a system turn of more than
``system_tokens`` later windows repeat the first words up to that number; the first window has it whole. So a window has at most
new_tokens + history_tokens + system_tokens, unless one turn alone is longer. The loss mask covers the texts of new
assistant turns only; what is repeated is context, never a target.

Template: ``<turn:ROLE>TEXT</turn>\\n`` for each turn. In texts ``&`` and ``<`` become ``&amp;`` and ``&lt;``, in roles ``>``
becomes ``&gt;`` as well, so that no text can hold a control string and parsing restores every text exactly.

Prefix sums and history run over a whole conversation without any task that holds it. Turn numbers are cut into blocks of
2^BLOCK_BITS, in which sums are taken first; each block's last row (sums and its last turns) goes on to the block of blocks, and those
to the conversation; what stands before each block comes back by a join. Where turns are numbered has no effect on the
windows. A task streams a block's turns, at most 2^GROUP_BITS blocks, or one row for each such group of a conversation. A window
holds at most N / 4 turns (each costs 4 tokens for its marks).

Cases: null text is empty, null role is an empty role, null conv_id is a conversation of its own, null turns come first;
rows repeated in conv_id and turn are turns of their own, ordered by role and text; an empty table gives no window; other
columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunklake.llm.common import plain, word_count

BLOCK_BITS, GROUP_BITS = 8, 16
#: Tokens that a turn's marks count beside its words.
MARKS = 4
OPEN, CLOSE = "<turn:", "</turn>\n"
NO_TURN = -(2**63)


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(escaped(role), F.lit(">"), F.lit("&gt;")), F.lit(">"), escaped(text), F.lit(CLOSE))


def first_words(text: Column, n: int) -> Column:
    return F.regexp_extract(text, rf"^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{0,{n - 1}}}[^\x20\x09-\x0D]*", 0)


def _last_of(turns: Column, n: int) -> Column:
    return F.slice(turns, F.greatest(F.size(turns) - n + 1, F.lit(1)), n) if n else turns


def _summed(rows: DataFrame, key: list[str], by: str, history: int, empty: Column) -> DataFrame:
    """rows (tokens, alone, n, tail) with sums over the rows before them in their key (before_tokens, ...), the last turns before
    them (before_tail) and whether they are the key's last (last)."""
    order = W.partitionBy(*key).orderBy(by)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    sums = {f"before_{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("tokens", "alone", "n")}
    tails = F.concat(empty, *(F.coalesce(F.lag("tail", i).over(order), empty) for i in range(history, 0, -1)))
    return rows.withColumns(sums | {"before_tail": _last_of(tails, history), "last": F.lead(by).over(order).isNull()})


def _totals(rows: DataFrame, keep: list[str], history: int) -> DataFrame:
    """One row for each key: the sums with its last row, and its last turns."""
    sums = [(F.col(f"before_{c}") + F.col(c)).alias(c) for c in ("tokens", "alone", "n")]
    return rows.where("last").select(*keep, *sums, _last_of(F.concat("before_tail", "tail"), history).alias("tail"))


def _joined(rows: DataFrame, sums: DataFrame, key: list[str]) -> DataFrame:
    """rows with what stands before their group beside what stands before them in it. rows lie by this key already: they stay there."""
    names = ("before_tokens", "before_alone", "before_n", "before_tail")
    return rows.join(sums.select(*key, *(F.col(c).alias(f"_{c}") for c in names)), key)


def positions(turns: DataFrame, half: int, history: int) -> DataFrame:
    """conv_id, role, text, tokens, at (place in the conversation), start (tokens before), alone (turns so far of more than ``half``
    tokens) and, where a window can begin, before (the last turns before it)."""
    turn = "struct<tokens:bigint,role:string,text:string>"
    empty = F.expr(f"cast(array() as array<{turn}>)")
    # a struct, so that a null conv_id is equal to itself
    t = turns.select(F.struct("conv_id").alias("conv"), F.coalesce("turn", F.lit(NO_TURN)).cast("long").alias("turn"), plain(F.col("role")).alias("role"), plain(F.col("text")).alias("text"))
    t = t.withColumn("tokens", word_count(F.col("text")) + MARKS).withColumn("own", F.col("tokens") > half).withColumn("block", F.shiftright("turn", BLOCK_BITS))
    order = W.partitionBy("conv", "block").orderBy("turn", "role", "text")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    self = F.struct("tokens", "role", "text")
    back = F.filter(F.array(*(F.lag(self, i).over(order) for i in range(history, 0, -1))), lambda x: x.isNotNull()) if history else empty
    t = t.withColumns(
        {
            "at": F.count(F.lit(1)).over(before),
            "start": F.coalesce(F.sum("tokens").over(before), F.lit(0)),
            "alone": F.count(F.when(F.col("own"), 1)).over(order.rowsBetween(W.unboundedPreceding, 0)),
            "back": back,
            "last": F.lead("turn").over(order).isNull(),
        }
    )
    group = F.shiftright("block", GROUP_BITS).alias("group")
    tail = _last_of(F.concat("back", F.array(self)), history) if history else empty
    blocks = t.where("last").select("conv", "block", group, (F.col("start") + F.col("tokens")).alias("tokens"), "alone", (F.col("at") + 1).alias("n"), tail.alias("tail"))
    blocks = _summed(blocks, ["conv", "group"], "block", history, empty)
    groups = _summed(_totals(blocks, ["conv", "group"], history), ["conv"], "group", history, empty)
    sums = _joined(blocks, groups, ["conv", "group"])
    added = [(F.col(f"before_{c}") + F.col(f"_before_{c}")).alias(f"before_{c}") for c in ("tokens", "alone", "n")]
    sums = sums.select("conv", "block", *added, _last_of(F.concat("_before_tail", "before_tail"), history).alias("before_tail"))
    t = _joined(t, sums, ["conv", "block"])
    lasts = _last_of(F.concat("_before_tail", "back"), history) if history else empty
    return t.select(
        "conv.conv_id", "role", "text", "tokens", "own", (F.col("at") + F.col("_before_n")).alias("at"), (F.col("start") + F.col("_before_tokens")).alias("start"),
        (F.col("alone") + F.col("_before_alone")).alias("alone"), lasts.alias("before"),
    )


def format_windows(turns: DataFrame, new_tokens: int = 384, history: int = 2, history_tokens: int = 96, system_tokens: int = 160) -> DataFrame:
    """conv_id, window (place of its first new turn), tokens, context (leading turns that are repeated), text and loss (spans of text, from 0)."""
    half = new_tokens // 2
    t = positions(turns, half, history)
    # a turn that is a window of its own gets a number that no other turn has
    t = t.withColumn("cell", F.struct(F.floor(F.col("start") / half).alias("cell"), "alone", "own"))
    # a window begins where the turn before is of another cell; only such turns carry what stands before them
    prior = F.get("before", F.size("before") - 1)["tokens"] if history else F.lit(None).cast("long")
    same = prior.isNotNull() & ~F.col("own") & (prior <= half) & (F.floor((F.col("start") - prior) / half) == F.col("cell.cell"))
    t = t.withColumn("before", F.when(~F.coalesce(same, F.lit(False)), F.col("before")))
    w = t.groupBy("conv_id", "cell").agg(F.array_sort(F.collect_list(F.struct("at", "tokens", "role", "text"))).alias("turns"), F.min("at").alias("window"), F.min_by("before", "at").alias("before"))

    # The system turn is the conversation's first; one row per conversation that has it.
    firsts = turns.groupBy("conv_id").agg(F.min(F.struct(F.coalesce("turn", F.lit(NO_TURN)).cast("long").alias("turn"), plain(F.col("role")).alias("role"), plain(F.col("text")).alias("text"))).alias("first")).where("first.role = 'system'")
    w = w.alias("w").join(firsts.alias("f"), F.col("w.conv_id").eqNullSafe(F.col("f.conv_id")), "left").select("w.*", "first")
    shown = first_words(F.col("first.text"), system_tokens - MARKS)
    repeated = F.col("first").isNotNull() & (F.col("window") > 0)
    empty = F.expr("cast(array() as array<struct<tokens:bigint,role:string,text:string>>)")
    system = F.when(repeated, F.array(F.struct((word_count(shown) + MARKS).alias("tokens"), F.col("first.role").alias("role"), shown.alias("text")))).otherwise(empty)
    kept, used = empty, F.lit(0).cast("long")
    for i in range(1, history + 1):
        b = F.get("before", F.size("before") - i)
        # the first turn is there already: it is the i-th before a window that begins at place i
        fits = b.isNotNull() & ~(F.col("first").isNotNull() & (F.col("window") == i)) & (used + b["tokens"] <= history_tokens) & (F.size(kept) == i - 1)
        fits = F.coalesce(fits, F.lit(False))
        kept, used = F.when(fits, F.concat(F.array(b), kept)).otherwise(kept), F.when(fits, used + b["tokens"]).otherwise(used)
    w = w.withColumn("context", F.concat(system, kept))
    return _rendered_windows(w)


def _rendered_windows(w: DataFrame) -> DataFrame:
    shown = lambda x: rendered(x["role"], x["text"])
    w = w.withColumns({"head": F.array_join(F.transform("context", shown), ""), "parts": F.transform("turns", shown)})
    zero = F.struct(F.length("head").cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans"))

    def step(a: Column, i: Column) -> Column:
        turn, part = F.get("turns", i), F.get("parts", i)
        size = F.length(part).cast("long")
        body = F.length(escaped(turn["text"])).cast("long")
        span = F.struct((a["at"] + size - len(CLOSE) - body).alias("start"), body.alias("length"))
        return F.struct((a["at"] + size).alias("at"), F.when(turn["role"] == "assistant", F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    spans = F.aggregate(F.sequence(F.lit(0), F.size("turns") - 1), zero, step, lambda a: a["spans"])
    tokens = F.aggregate(F.concat(F.transform("context", lambda x: x["tokens"]), F.transform("turns", lambda x: x["tokens"])), F.lit(0).cast("long"), lambda a, x: a + x)
    return w.select("conv_id", "window", tokens.alias("tokens"), F.size("context").alias("context"), F.concat("head", F.array_join("parts", "")).alias("text"), spans.alias("loss"))


def parsed(text: Column, skip: Column) -> Column:
    """The turns (role, text) of a window's text after the first ``skip``."""
    blocks = F.split(text, CLOSE)
    blocks = F.slice(blocks, skip + 1, F.size(blocks) - 1 - skip)  # after the last mark stands nothing

    def turn(x: Column) -> Column:
        role = F.substring_index(F.substr(x, F.lit(len(OPEN) + 1)), ">", 1)
        return F.struct(unescaped(F.replace(role, F.lit("&gt;"), F.lit(">"))).alias("role"), unescaped(F.substr(x, F.lit(len(OPEN) + 2) + F.length(role))).alias("text"))

    return F.transform(blocks, turn)


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation, from windows' texts and loss spans alone.

    A digest of a whole conversation needs its text in one value: it is the one place that holds a conversation whole.
    """
    said = F.array_join(F.transform(parsed(F.col("text"), F.col("context")), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss", lambda s: unescaped(F.substr(F.col("text"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    per = windows.select("conv_id", "window", said.alias("said"), loss.alias("loss"), (F.size(F.split("text", CLOSE)) - 1 - F.col("context")).alias("n"), F.length("text").alias("chars"))
    one = per.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "said", "loss"))).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"))
    masked = F.array_join(F.col("w.loss"), "")
    return one.select("conv_id", "n_turns", F.sha2(F.array_join(F.col("w.said"), ""), 256).alias("turns_sha256"), F.length(masked).cast("long").alias("loss_chars"), F.sha2(masked, 256).alias("loss_sha256"), "formatted_chars", "n_windows")
