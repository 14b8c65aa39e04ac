"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it are context, only its text is trainable. The text of an example is the text of
the example before it plus what follows up to its own target, so :func:`examples` gives what each adds (``added``) and the span of the
reply in it, and :func:`expand` makes the whole examples of these. Turns after the last reply make a last row without a reply.

Template: <|im_start|>role, line end, text, <|im_end|>, line end. Inside roles and texts & is written &amp; and <| is written &lt;|, so no
control string can stand there, and reading gives back every text as it was. Plain DataFrame functions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.skew import join_counted, running_sum
from waymark.session import written

START, END = "<|im_start|>", "<|im_end|>\n"
#: Turns that are numbered together; a longer conversation is dealt over tasks.
SPAN = 1024
#: Characters of whole examples that one row of a conversation makes; the examples of a longer one are dealt over tasks.
EXAMPLE_CHARS = 2**26


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def examples(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """One row per reply, and one for the turns after the last reply: ``conv``, example (from 0), added, loss_start, loss_end (in ``added``; null without a reply).

    Turns go by ``turn`` (null first), then role and text; repeated turns all stay. A null role or text counts as empty; rows with a null ``conv``
    are one conversation. Texts are taken whole, other columns aren't read; an empty table gives no example.
    """
    rows = conversations.select(
        F.col(conv).alias("conv"), F.when(F.col(conv).isNull(), "null").otherwise(F.concat(F.lit("="), F.col(conv).cast("string"))).alias("key"), F.col(turn).alias("turn"),
        F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"),
    )
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    bucket = F.coalesce(F.floor(F.col("turn") / SPAN), F.lit(-(2**40))).cast("long")
    placed = running_sum(rows, ["key"], order, bucket, (F.col("role") == target).cast("int"), "example")
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    escaped = placed.select("conv", "key", "example", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "head", "body")))
    own = escaped.groupBy("key", "example").agg(F.first("conv").alias("conv"), turns.alias("turns"))
    # the reply, if there is one, is the last turn of its row by construction
    is_reply = lambda t: t["role"] == target
    ordered = F.concat(F.filter("turns", lambda t: ~is_reply(t)), F.filter("turns", is_reply))
    text_of = F.concat_ws("", F.transform(ordered, lambda t: F.concat(t["head"], t["body"], F.lit(END))))
    last = F.element_at(F.filter("turns", is_reply), 1)
    sized = own.select(
        "conv", "key", "example", text_of.alias("added"), F.exists("turns", is_reply).alias("reply"),
        F.when(F.exists("turns", is_reply), F.length(last["body"])).cast("long").alias("loss"),
    )
    end = F.length("added") - len(END)
    return sized.select(
        F.col("conv").alias(conv), "example", "added", F.when(F.col("reply"), end - F.col("loss")).cast("long").alias("loss_start"), F.when(F.col("reply"), end).cast("long").alias("loss_end"),
    )


def expand(rows: DataFrame, conv: str = "conv_id", chars: int = EXAMPLE_CHARS) -> DataFrame:
    """The whole examples: ``conv``, example, text, loss_start, loss_end in it, and whether it is the ``last`` of its conversation.

    Whole texts grow with the square of a conversation's length. They are made where the conversation lies and go from row to row, so only the rows of
    :func:`examples` are shuffled; a conversation with more than ``chars`` characters of examples goes to several tasks, each of which makes some.
    """
    rows = written(rows, "examples").withColumn("whose", F.to_json(F.struct(F.col(conv).alias("c"))))
    made = F.sum(F.length("added").cast("long")) * F.count(F.lit(1))
    long = rows.groupBy("whose").agg(F.floor(made / F.lit(chars)).alias("more")).where("more > 0")
    keys = ["whose"]
    if not long.isEmpty():
        rows = join_counted(rows, long, ["whose"], "left").withColumn("parts", F.coalesce("more", F.lit(0)) + 1)
        rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        keys = ["whose", "part", "parts"]
    piece = F.struct("example", F.length("added").alias("n"), "loss_start", "loss_end", "added")
    whole = rows.groupBy(*keys).agg(F.first(conv).alias(conv), F.sort_array(F.collect_list(piece)).alias("pieces"))
    # the characters before each example; far less work than its text
    before = F.transform("pieces", lambda p, i: F.struct(
        p["example"].alias("example"), p["n"].alias("n"), p["loss_start"].alias("s"), p["loss_end"].alias("e"), (i == F.size("pieces") - 1).alias("last"),
        F.aggregate(F.slice("pieces", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("at"),
    ))
    if len(keys) > 1:
        before = F.filter(before, lambda b: F.pmod(b["example"], F.col("parts")) == F.col("part"))
    each = whole.select(conv, F.concat_ws("", "pieces.added").alias("all"), before.alias("each")).select(conv, "all", F.explode("each").alias("b"))
    text = F.substring(F.col("all"), F.lit(1), (F.col("b.at") + F.col("b.n")).cast("int"))
    return each.select(conv, "b.example", text.alias("text"), (F.col("b.at") + F.col("b.s")).alias("loss_start"), (F.col("b.at") + F.col("b.e")).alias("loss_end"), "b.last")


def turns_of(text: Column) -> Column:
    """Array of (role, text) that a formatted text holds, as they were before formatting."""
    parts = F.filter(F.split(text, r"<\|im_start\|>"), lambda x: x != "")

    def read(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substring(part, F.length(role) + 2, F.length(part) - F.length(role) - 1 - len(END))
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, read)


def digests(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the whole examples of a conversation hold, read back from them: turns (of the last, which has them all) and loss text as counts and SHA-256, and the characters of all."""
    loss = unescape(F.coalesce(F.substring(F.col("text"), F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int")), F.lit("")))
    turns = F.when(F.col("last"), turns_of(F.col("text")))
    read = expand(rows, conv).select(conv, "example", turns.alias("turns"), loss.alias("loss"), F.length("text").cast("long").alias("chars"))
    flat = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    read = read.select(conv, "example", F.size("turns").cast("long").alias("n"), F.when(F.col("turns").isNotNull(), flat).alias("flat"), "loss", "chars")
    whole = read.groupBy(conv).agg(
        F.max(F.when(F.col("flat").isNotNull(), F.col("n"))).alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.max("flat").alias("flat"), F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("parts"),
    ).withColumn("loss", F.concat_ws("", "parts.loss"))
    return whole.select(conv, "n_turns", F.sha2("flat", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
