"""Chat formatting: event logs folded into final messages, rendered with a loss mask, and read back.

Events have a conversation, a sequence number, a message number, a kind, a role and a text. `message` starts a message with its
text; `delta` appends to it; `edit` replaces what it says; `regenerate` drops it, and what follows builds the new one. A
conversation's messages are ordered by their first event.

Results for odd input: a null text or role counts as empty; events of one sequence number are ordered by role, text and kind;
repeated `message` rows are turns of their own, while a repeated delta, the same in all columns, was delivered again and counts
once; messages that begin at one number are ordered by role and text; a delta without a message starts one; an empty log gives
an empty result. A log is dealt out once, by conversation. Conversations of over LONG events are folded message by message, and
only their finished text, which is one value by its nature, meets in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The template's control strings.
BEGIN, HEAD, BODY, END = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = r"(/?(?:s>|INST\]|SYS\]))"
#: Events from which on a conversation isn't folded in one task, and the number of such conversations that are broadcast.
LONG, BROADCAST = 2048, 100_000


def escape(text: Column) -> Column:
    """Puts a tilde into every control string, and one more into those that have tildes already."""
    return F.regexp_replace(text, r"([<\[])(~*)" + _CONTROL, "$1~$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])~(~*)" + _CONTROL, "$1$2$3")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, first_seq, msg, n, role, text), a row for each final message, from (conv_id, seq, msg, kind, role, text)."""
    e = events.select("conv_id", "seq", "msg", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sort = Window.partitionBy("conv_id", "msg").orderBy("seq", "role", "text", "kind")
    order = sort.rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag(F.struct("seq", "role", "text", "kind")).over(sort)
    again = (F.col("kind") == "delta") & before.eqNullSafe(F.struct("seq", "role", "text", "kind"))
    e = e.withColumn("again", again).withColumn("text", F.when(F.col("again"), "").otherwise(F.col("text"))).drop("again")
    fresh = F.col("kind").isin("message", "edit", "regenerate").cast("int")
    e = e.withColumns({"n": F.sum((F.col("kind") == "message").cast("int")).over(order), "version": F.sum(fresh).over(order), "at": F.count("*").over(order)})
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "")
    first = F.min(F.struct("at", "seq", "role"))
    versions = e.groupBy("conv_id", "msg", "n", "version").agg(whole.alias("text"), first.alias("first"))
    last = versions.groupBy("conv_id", "msg", "n").agg(F.max_by("text", "version").alias("text"), F.min("first").alias("first"))
    return last.select("conv_id", F.col("first.seq").alias("first_seq"), "msg", "n", F.col("first.role").alias("role"), "text")


def turns(messages: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>) in order."""
    one = F.struct("first_seq", "role", "text", "msg", "n")
    whole = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("found"))
    return whole.select("conv_id", F.transform("found", lambda x: F.struct(x["role"], x["text"])).alias("turns"))


def render(conversations: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss_mask): the mask has for each turn where in it the trained characters start, and how many they are."""
    piece = lambda t: F.concat(F.lit(BEGIN + HEAD), escape(t["role"]), F.lit(BODY), escape(t["text"]), F.lit(END))
    at = lambda t: F.length(escape(t["role"])) + len(BEGIN + HEAD + BODY)
    mask = lambda t: F.struct(at(t).alias("start"), F.when(t["role"].isin(*trained), F.length(escape(t["text"]))).otherwise(0).alias("chars"))
    return conversations.select("conv_id", F.array_join(F.transform("turns", piece), "").alias("formatted"), F.transform("turns", mask).alias("loss_mask"))


def parse(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss array<string>), all taken from the formatted text and its mask."""
    pieces = F.split("formatted", END)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    bare = lambda p: F.substring(p, F.lit(len(BEGIN + HEAD) + 1), F.length(p))
    head = lambda p: F.substring_index(bare(p), BODY, 1)
    turn = lambda p: F.struct(unescape(head(p)).alias("role"), unescape(F.substring(bare(p), F.length(head(p)) + len(BODY) + 1, F.length(p))).alias("text"))
    out = formatted.withColumn("pieces", pieces)
    masked = F.zip_with("pieces", "loss_mask", lambda p, m: F.when(m["chars"] > 0, unescape(F.substring(p, m["start"] + 1, m["chars"]))).otherwise(F.lit("")))
    return out.select("conv_id", "formatted", F.transform("pieces", turn).alias("turns"), masked.alias("loss"))


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, turns) of a whole log."""
    long = events.groupBy("conv_id").count().where((F.col("count") > LONG) & F.col("conv_id").isNotNull()).select("conv_id")
    n = long.count()
    if not n:
        return turns(fold(events.repartition("conv_id")))
    long = F.broadcast(long) if n <= BROADCAST else long
    usual = turns(fold(events.join(long, "conv_id", "left_anti").repartition("conv_id")))
    return usual.unionByName(turns(fold(events.join(long, "conv_id", "left_semi"))))


def format_log(events: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """From an event log to (conv_id, formatted, loss_mask)."""
    return render(reconstruct(events), trained)
