"""Chat formatting by quotation linking, in DataFrame functions.

Quoted lines carry one ``>`` for each level. Passages are the lines of one level that stand
together; a passage and each of its lines are normalised and hashed, and joined to the hashes of
what the messages of the same conversation say themselves. The earliest message that says it is
the original. A message replies to the message that most of its first-level passages come from;
replies are ordered below what they reply to, without the quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibloom.llm.common import discard, materialize, with_positions

_QUOTE = r"^[ \t]*((?:>[ \t]?)+)"
#: A safety stop; each round doubles the distance that is known.
MAX_ROUNDS = 60


def normalized(text: Column) -> Column:
    """Lower case, with single spaces between words and none around."""
    return F.trim(F.lower(F.regexp_replace(text, r"\s+", " ")))


def parse(messages: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, blocks): the message as an array of (level, line) in order; null texts have none."""
    lines = F.split(text, "\n")

    def line(x: Column) -> Column:
        mark = F.regexp_extract(x, _QUOTE, 1)
        level = F.length(F.regexp_replace(mark, "[^>]", ""))
        return F.struct(level.alias("level"), F.when(level > 0, F.regexp_replace(x, _QUOTE, "")).otherwise(x).alias("line"))

    blocks = F.coalesce(F.transform(lines, line), F.array().cast("array<struct<level:int,line:string>>"))
    return messages.select(*keys, blocks.alias("blocks"))


def own_text(blocks: str) -> Column:
    """What the message says itself: its unquoted lines, without blank ones at either end."""
    said = F.transform(F.filter(F.col(blocks), lambda b: b["level"] == 0), lambda b: b["line"])
    return F.regexp_replace(F.array_join(said, "\n"), r"^\s+|\s+$", "")


def passages(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, level, hash, whole): every line and every passage that isn't blank, hashed after
    normalising; whole marks a passage of more than one line."""
    lines = parsed.select(*keys, F.posexplode_outer("blocks").alias("at", "block"))
    lines = lines.select(*keys, "at", F.col("block.level").alias("level"), normalized(F.col("block.line")).alias("line"))
    single = lines.where(F.col("line") != "").select(*keys, "level", F.xxhash64("line").alias("hash"), F.lit(False).alias("whole"))

    # runs of one level within a message, joined; a message is one row, so this stays in it
    start = F.struct(F.lit(-1).alias("level"), F.array().cast("array<string>").alias("lines"))
    empty = F.array().cast("array<struct<level:int,lines:array<string>>>")

    def add(runs: Column, block: Column) -> Column:
        last = F.coalesce(F.get(runs, F.size(runs) - 1), start)
        more = F.array(F.struct(block["level"].alias("level"), F.concat(last["lines"], F.array(block["line"])).alias("lines")))
        new = F.array(F.struct(block["level"].alias("level"), F.array(block["line"]).alias("lines")))
        return F.when(last["level"] == block["level"], F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), more)).otherwise(F.concat(runs, new))

    runs = parsed.select(*keys, F.explode_outer(F.aggregate("blocks", empty, add)).alias("run"))
    runs = runs.where(F.size("run.lines") > 1)
    joined = runs.select(*keys, F.col("run.level").alias("level"), normalized(F.array_join("run.lines", " ")).alias("line"))
    whole = joined.where(F.col("line") != "").select(*keys, "level", F.xxhash64("line").alias("hash"), F.lit(True).alias("whole"))
    return single.unionByName(whole)


def link(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every message in reply order, without quotes: conversation, position (from 0 in the
    conversation), turn, role, content, reply_to (turn; null for none), depth (replies above
    it), root (turn of the thread's first message), n_quotes (quoted lines), n_linked (those
    whose original was found).

    A reply stands in its root's thread, threads in the order of their roots, messages of a
    thread in the order of their turns, so a reply always comes after what it answers. Messages
    whose quotes lead to no earlier message are roots. Ties between two candidates go to the one
    with more linked lines, then the later one. Null texts have empty content and no quotes;
    rows that repeat conversation and turn keep a position each and are linked as one message
    (the first by role and text); a null conversation is one of its own, a null turn comes first
    and links nothing. Other columns are dropped; an empty table gives an empty result.
    """
    rows = messages.select(
        F.col(conversation).alias("_conv"),
        F.coalesce(F.concat(F.lit("c"), F.col(conversation).cast("string")), F.lit("")).alias("c"),
        F.col(turn).cast("long").alias("t"),
        F.col(role).alias("role"),
        F.col(text).alias("text"),
    )
    parsed = parse(rows.where(F.col("t").isNotNull()), ["c", "t"], "text")
    parts = materialize(passages(parsed, ["c", "t"]), "passages")
    quoted = parts.where(F.col("level") > 0)
    # originals: the earliest message that says it; combined before the shuffle, so a passage
    # that every message repeats is one row
    said = parts.where(F.col("level") == 0).groupBy("c", "hash").agg(F.min("t").alias("original"))
    found = quoted.join(said, ["c", "hash"]).where(F.col("original") < F.col("t"))
    linked = materialize(found.groupBy("c", "t", "level", "original").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("whole")).cast("int")).alias("lines")), "quote-links")
    first_level = linked.where(F.col("level") == 1).groupBy("c", "t").agg(F.max_by("original", F.struct("n", "original")).alias("parent"))
    counts = quoted.where(~F.col("whole")).groupBy("c", "t").agg(F.count(F.lit(1)).alias("n_quotes"))
    resolved = linked.groupBy("c", "t").agg(F.sum("lines").alias("n_linked"))
    info = counts.join(resolved, ["c", "t"], "left").join(threads(first_level), ["c", "t"], "left")
    body = parse(rows, ["_conv", "c", "t", "role", "text"], "text").withColumn("content", own_text("blocks")).drop("blocks", "text")
    placed = body.join(info, ["c", "t"], "left").withColumn("root", F.coalesce("root", "t"))
    order = [F.col("root").asc_nulls_first(), F.col("t").asc_nulls_first(), F.col("role").asc_nulls_first(), F.xxhash64("content").asc()]
    placed = with_positions(placed, ["c"], order, "position", "_size")
    whole = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)
    return placed.select(
        F.col("_conv").alias(conversation),
        "position",
        F.col("t").alias(turn),
        F.col("role").alias(role),
        F.col("content"),
        F.col("parent").alias("reply_to"),
        whole("depth"),
        "root",
        whole("n_quotes"),
        whole("n_linked"),
    )


def threads(parents: DataFrame) -> DataFrame:
    """(c, t, parent, root, depth) of every reply, by pointer doubling; a parent is always an
    earlier turn, so there are no circles."""
    now = materialize(parents.select("c", "t", "parent", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "threads")
    for _ in range(MAX_ROUNDS):
        above = now.select("c", F.col("t").alias("root"), F.col("root").alias("higher"), F.col("depth").alias("more"))
        joined = now.join(above, ["c", "root"], "left")
        after = materialize(
            joined.select("c", "t", "parent", F.coalesce("higher", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("moved")),
            "threads",
        )
        discard(now)
        now = after.drop("moved")
        if after.where("moved").isEmpty():
            return now
    raise RuntimeError(f"threads did not settle in {MAX_ROUNDS} rounds")
