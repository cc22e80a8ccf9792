"""Quotation linking: who answers whom, from the passages that messages quote.

A line's quote level is the number of ``>`` in front of it. Lines of one level that stand together
without a blank line make a passage; passages and their single lines are normalised (lower case, nothing
but letters, digits and single spaces) and hashed, so a quote is found re-wrapped, in part, or nested at
any level. A quoted passage belongs to the first message of the conversation that has it as its own
text, if that message is earlier. A message answers the message that most of its level-1 quotes, by
characters, belong to (of equals the later one); deeper levels link to the messages further up.

Answers make trees. A thread's root and a message's depth come from doubling steps, each of which
doubles the reach of all messages at once. Read by conversation, root and turn, every answer stands
after what it answers, and threads stand together; the result comes in that order, sorted by ranges, so
that a conversation of any size is never in one task. Passages are reduced to their first message
before the join, so equal passages never pair up. All of it is DataFrame expressions.

Null texts are empty; a null conv_id is a conversation of its own, a null turn comes before all others;
rows of one conversation and turn are one message, and each gives a row; an empty table gives none;
other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import stored

_BREAK = r"\r?\n"
#: Possessive, as Java's matcher recurses once per repetition of a group that it may give back.
_MARKS = r"^(?:[ \t]*+>)*+"
#: Stands for a null turn.
_FIRST = -(1 << 63)

MESSAGE = ["conv", "at"]


def normal(text: Column) -> Column:
    """Letters and digits in lower case, single spaces between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def own_text(text: Column) -> Column:
    """The lines that aren't quotes, without blank lines at the ends and with single ones between."""
    own = F.filter(F.split(F.coalesce(text, F.lit("")), _BREAK), lambda x: ~x.rlike(r"^[ \t]*>"))
    single = F.regexp_replace(F.array_join(own, "\n"), r"\n[ \t]*+\n[ \t\n]*+", "\n\n")
    return F.regexp_replace(single, r"^\s++|(?<!\s)\s++$", "")


def _messages(df: DataFrame, conv_id: str, turn: str, text: str) -> DataFrame:
    return df.select(
        F.coalesce(F.concat(F.lit("c"), F.col(conv_id).cast("string")), F.lit("")).alias("conv"),
        F.coalesce(F.col(turn).cast("bigint"), F.lit(_FIRST)).alias("at"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )


def passages(messages: DataFrame) -> DataFrame:
    """``conv, at, level, size, mark``: the passages and lines of each message, hashed."""
    message = [*MESSAGE, "h"]
    lines = (
        messages.withColumn("h", F.xxhash64("text"))
        .dropDuplicates(message)
        .select(*message, F.posexplode(F.split("text", _BREAK)).alias("pos", "line"))
        .select(
            *message,
            "pos",
            F.length(F.regexp_replace(F.regexp_extract("line", _MARKS, 0), "[^>]", "")).alias("level"),
            normal(F.regexp_replace("line", _MARKS, "")).alias("body"),
        )
    )
    # Both windows hold the lines of one message.
    down = Window.partitionBy(*message).orderBy("pos")
    begins = (F.lag("level").over(down) != F.col("level")) | (F.lag("body").over(down) == "")
    runs = (
        lines.withColumn("run", F.sum(F.when(begins, 1).otherwise(0)).over(down))
        .filter(F.col("body") != "")
        .groupBy(*message, "run", "level")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "body"))).alias("lines"))
        .select(*MESSAGE, "level", F.array_join(F.col("lines.body"), " ").alias("whole"), F.col("lines.body").alias("bodies"))
    )
    units = runs.select(*MESSAGE, "level", F.explode(F.array_append("bodies", F.col("whole"))).alias("body"))
    return units.select(
        *MESSAGE,
        "level",
        F.length("body").cast("bigint").alias("size"),
        F.sha2(F.col("body").cast("binary"), 256).alias("mark"),
    ).distinct()


def quote_links(messages: DataFrame) -> DataFrame:
    """``conv, at, level, size, mark, origin``: quoted passages; ``origin`` is the turn they come from, if any."""
    units = passages(messages)
    origins = units.filter("level = 0").groupBy("conv", "mark").agg(F.min("at").alias("origin"))
    quotes = units.filter("level > 0")
    joined = quotes.join(origins, ["conv", "mark"], "left")
    earlier = F.when(F.col("origin") < F.col("at"), F.col("origin"))
    return joined.withColumn("origin", earlier)


def threads(answers: DataFrame) -> DataFrame:
    """``conv, at, parent, root, depth`` of the messages that answer one, from ``conv, at, parent``."""
    # The reach of a message that answers none is itself, so an inner miss ends a chain.
    state = stored(answers.withColumns({"root": F.col("parent"), "depth": F.lit(1).cast("bigint")}), "threads")
    while True:
        above = state.select("conv", F.col("at").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        longer = state.join(above, ["conv", "root"], "left").select(
            *MESSAGE,
            "parent",
            F.coalesce("next", "root").alias("root"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.col("next").isNotNull().alias("moved"),
        )
        longer = stored(longer, "threads")
        if longer.filter("moved").isEmpty():
            return longer.drop("moved")
        state = longer.drop("moved")


def reply_order(
    df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Every message without its quotes, in reply order.

    ``reply_to`` is the turn that it answers (null: none), ``root`` the turn that its thread starts with,
    ``depth`` its distance from there, ``n_quotes`` its quoted passages and lines, ``n_linked`` those that
    were found in an earlier message.
    """
    links = stored(quote_links(_messages(df, conv_id, turn, text)), "links")
    counts = links.groupBy(*MESSAGE).agg(F.count(F.lit(1)).alias("n_quotes"), F.count("origin").alias("n_linked"))
    votes = links.filter("level = 1 AND origin IS NOT NULL").groupBy(*MESSAGE, "origin").agg(F.sum("size").alias("votes"))
    answers = votes.groupBy(*MESSAGE).agg(F.max(F.struct("votes", "origin"))["origin"].alias("parent"))
    found = counts.join(threads(answers), MESSAGE, "left")

    rows = df.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), own_text(F.col(text)).alias("text"),
        F.coalesce(F.concat(F.lit("c"), F.col(conv_id).cast("string")), F.lit("")).alias("conv"),
        F.coalesce(F.col(turn).cast("bigint"), F.lit(_FIRST)).alias("at"),
    )

    def real(name: str) -> Column:
        return F.when(F.col(name) != _FIRST, F.col(name))

    joined = rows.join(found, MESSAGE, "left").withColumn("first", F.coalesce("root", "at"))
    return joined.orderBy("conv_id", "first", "at").select(
        "conv_id",
        "turn",
        "role",
        "text",
        real("parent").alias("reply_to"),
        real("first").alias("root"),
        F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"),
        F.coalesce("n_quotes", F.lit(0)).cast("bigint").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
    )
