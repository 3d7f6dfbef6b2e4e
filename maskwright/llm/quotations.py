"""Chat formatting by quotation linking (DataFrame functions only).

Lines that begin with ``>`` marks are quotes, one level for each mark. Lines of one
level that follow each other make a passage; a blank line ends it. What a message has
of its own makes passages in the same way. Passages are cut into sentences too, all are
normalised (letters and digits, lower case) and hashed: so a quote is found however a
mail program has wrapped it, and also where it quotes one sentence out of a paragraph.
The beginning of a longer sentence is hashed besides, so that a quote that breaks off
after eight words or more is found. The original is the last earlier message that has
the passage or sentence of its own; so a quote meets one original at most, however often
a text recurs. A message
replies to the original that most characters of its quotes at the outermost matched
level come from (ties: the latest), which is an earlier message. Threads are found by
doubling the reach of the reply links, and conversations come thread by thread, each
reply after what it answers, with quotes and the "... wrote:" lines above them removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

# fixed values: how mail programs begin the line above a quotation, by language
WROTE = r"(?i)^.{0,200}\b(wrote|schrieb|a écrit|escribió)\s*:\s*$"
# fixed values: how such a line begins where it has been folded in two
FOLDED = r"(?i)^\s*(on|am|le|el)\b.{1,200}$"
#: Words of a sentence's beginning that link a quote cut off in its middle.
PREFIX = 8


def _level(line: Column) -> Column:
    marks = F.regexp_extract(line, r"^\s*((?:>\s?)*+)", 1)
    return F.when(F.contains(line, F.lit(">")), F.length(F.regexp_replace(marks, r"[^>]", ""))).otherwise(0)


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s*(?:>\s?)*+", "")


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _passages(lines: Column) -> Column:
    """array<struct<level, text>>: neighbouring lines of one level as one text; a line without letters or digits stands alone."""
    blank = lambda x: ~x["text"].rlike(r"[\p{L}\p{N}]")

    def piece(x: Column, i: Column) -> Column:
        before = F.get(lines, i - 1)
        begins = (i == 0) | (before["level"] != x["level"]) | blank(x) | blank(before)
        return F.concat(F.when(begins, F.concat(F.lit("\u0001"), x["level"].cast("string"), F.lit("\u0002"))).otherwise(F.lit(" ")), x["text"])

    whole = F.filter(F.split(F.array_join(F.transform(lines, piece), ""), "\u0001", -1), lambda t: t != "")
    return F.transform(whole, lambda t: F.struct(F.substring_index(t, "\u0002", 1).cast("int").alias("level"), F.substring_index(t, "\u0002", -1).alias("text")))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, lines (level, text), passages (level, text) and the text without quotes."""
    rows = messages.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("raw"))
    split = F.split(F.regexp_replace("raw", "\r\n?", "\n"), "\n", -1)
    lines = F.transform(split, lambda x: F.struct(_level(x).alias("level"), _bare(x).alias("text")))
    line = lambda i: F.get(F.col("lines"), i)
    quote_at = lambda i: (line(i)["level"] > 0) | ((line(i)["level"] == 0) & (F.trim(line(i)["text"]) == "") & (line(i + 1)["level"] > 0))  # noqa: E731  a blank line may stand before it
    ends = lambda i: (line(i)["level"] == 0) & quote_at(i + 1) & line(i)["text"].rlike(WROTE)
    wrote = lambda x, i: F.coalesce((x["level"] == 0) & (ends(i) | (ends(i + 1) & x["text"].rlike(FOLDED))), F.lit(False))
    own = F.filter("lines", lambda x, i: (x["level"] == 0) & ~wrote(x, i))
    said = F.transform("lines", lambda x, i: F.struct(x["level"].alias("level"), F.when(wrote(x, i), F.lit("")).otherwise(F.translate(x["text"], "\u0001\u0002", "  ")).alias("text")))
    text = F.trim(F.regexp_replace(F.array_join(F.transform(own, lambda x: x["text"]), "\n"), r"\n{3,}", "\n\n"), F.lit(" \n\t"))
    return rows.withColumn("lines", lines).withColumn("text", text).withColumn("said", said).withColumn("passages", _passages(F.col("said"))).drop("raw", "said")


def reply_links(rows: DataFrame) -> DataFrame:
    """conv_id, turn, parent, level, quotes, size: the message each quoting message replies to, how many passages and sentences say so and their characters."""
    # of a plain explode, a filter on the passages would be inferred and run before the join that thins the messages out
    each = rows.select("conv_id", "turn", F.explode_outer("passages").alias("p")).select("conv_id", "turn", "p.level", F.split("p.text", r"(?<=[.!?。！？])\s*(?=\S)").alias("parts"), "p.text")
    each = each.select("conv_id", "turn", "level", F.explode_outer(F.array_union(F.array("text"), "parts")).alias("text")).select("conv_id", "turn", "level", normalised(F.col("text")).alias("norm"))
    each = each.select("conv_id", "turn", "level", F.explode(F.array_distinct(F.array("norm", F.substring_index("norm", " ", PREFIX)))).alias("norm"))
    each = stored(each.filter("norm <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "level", F.xxhash64("norm").alias("hash"), F.length("norm").alias("size")), "passages")
    key = ["conv_id", "hash", "size"]
    quoted = stored(each.filter("level > 0").distinct(), "quoted")
    holders = each.filter("level = 0").distinct().join(quoted.select(*key).distinct(), key, "left_semi")
    # of all that have said it before the quoting message, the last
    before = W.partitionBy(*key).orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    met = quoted.unionByName(holders).withColumn("parent", F.max(F.when(F.col("level") == 0, F.col("turn"))).over(before)).filter("level > 0 AND parent IS NOT NULL")
    votes = met.groupBy("conv_id", "turn", "level", "parent").agg(F.count("*").alias("quotes"), F.sum("size").alias("size"))
    best = F.max(F.struct((-F.col("level")).alias("near"), F.col("size").alias("size"), F.col("parent").alias("parent"), F.col("quotes").alias("quotes"))).alias("best")
    return votes.groupBy("conv_id", "turn").agg(best).select("conv_id", "turn", "best.parent", (-F.col("best.near")).alias("level"), "best.quotes", "best.size")


def threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, parent, thread, depth of each message that replies: ``thread`` is the first message of its thread."""
    now = stored(links.select("conv_id", "turn", "parent", F.col("parent").alias("thread"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        up = now.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("thread").alias("_thread"), F.col("depth").alias("_depth"))
        step = now.join(up, (F.col("conv_id") == F.col("_conv")) & (F.col("thread") == F.col("_turn")), "left")
        reach = (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")
        step = step.select("conv_id", "turn", "parent", F.coalesce("_thread", "thread").alias("thread"), reach, F.col("_turn").isNotNull().alias("moved"))
        step = stored(step, "threads")
        now = step.drop("moved")
        if step.filter("moved").isEmpty():
            return now


def conversations(messages: DataFrame) -> DataFrame:
    """One row per message, in reply order: conv_id, thread, turn, reply_to, depth, role, text, quoted_lines, formatted.

    ``thread`` is the turn of the thread's first message, ``reply_to`` the turn
    answered (null: none), ``formatted`` the text under its role's tag. Null text
    counts as empty and null role as ``unknown``; rows without conv_id or turn stay,
    unlinked; rows that repeat (conv_id, turn) are linked alike. Very long messages
    count whole, an empty table gives no rows, further columns play no part.
    """
    rows = parsed(messages)
    quoting = messages.filter(F.col("text").cast("string").rlike(r"(?m)^[ \t\x0B\f]*+>")).select("conv_id").distinct()  # elsewhere there is nothing to link
    linked = threads(reply_links(parsed(messages.join(quoting, "conv_id", "left_semi"))))
    shape = rows.select("conv_id", "turn", "role", "text", F.size(F.filter("lines", lambda x: x["level"] > 0)).alias("quoted_lines"))
    out = shape.join(linked, ["conv_id", "turn"], "left")
    role = F.coalesce("role", F.lit("unknown"))
    return out.select(
        "conv_id", F.coalesce("thread", "turn").alias("thread"), "turn", F.col("parent").alias("reply_to"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), role.alias("role"), "text", "quoted_lines",
        F.concat(F.lit("<|"), role, F.lit("|>\n"), "text", F.lit("\n")).alias("formatted"),
    ).orderBy("conv_id", "thread", "turn")
