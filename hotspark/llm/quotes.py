"""Quotation linking: conversations from messages that quote each other.

A line's quote level is the number of `>` marks before it; a passage is a run of lines
of one level. A message's own text is its passages of level 0 without a line that
introduces the quote after it. Quoted passages are normalised and hashed and joined,
within a mailbox, to the first message whose own text, or a paragraph of it, has that
hash. A passage that is only a part of a message is joined by its paragraphs, and if
none is found by its lines and sentences, to the message that holds most of it. The
passage of the lowest level decides the parent. Roots and depths come from pointer
doubling. Conversations are the own texts of a thread in reply order: a message, then each
reply with all that answers it. Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hotspark.operators.ranking import number_rows
from hotspark.session import materialize

#: A line that introduces a quote.
INTRO = r"(?i)^\s*(on\b.*\bwrote|am\b.*\bschrieb\b.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$"
_MARKS = r"^(\s*>)+"
#: Letters that a line or sentence has at least to tell which message it is from.
PIECE_CHARS = 12


def normal(text: Column) -> Column:
    """A passage's text as it is compared: lower case, white space folded."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _name(text: Column) -> Column:
    return F.sha2(normal(text), 256)


def parse(messages: DataFrame, body: str) -> DataFrame:
    """The frame with `own` (text without quotes) and `quotes` (level and text of each quoted passage, in order).

    A null body counts as empty.
    """
    lines = F.split(F.regexp_replace(F.coalesce(F.col(body), F.lit("")), r"\r\n?", "\n"), "\n", -1)
    out = messages.withColumn("_lines", F.transform(lines, lambda s: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(s, _MARKS, 0), "[^>]", "")).alias("level"),
        F.regexp_replace(s, _MARKS + r"\s?", "").alias("text"))))
    # first line of each passage, then the passages between neighbouring firsts
    at = F.sequence(F.lit(1), F.size("_lines"))
    out = out.withColumn("_first", F.filter(at, lambda i: (i == 1) | (F.element_at("_lines", i)["level"] != F.element_at("_lines", F.greatest(i - 1, F.lit(1)))["level"])))
    out = out.withColumn("_runs", F.transform("_first", lambda i, k: F.struct(
        F.element_at("_lines", i)["level"].alias("level"),
        F.slice("_lines", i, F.coalesce(F.get("_first", k + 1), F.size("_lines") + 1) - i).alias("lines"))))
    # the last line with text before a quote goes if it introduces it
    at = F.transform("_runs", lambda r: F.array_max(F.transform(r["lines"], lambda t, i: F.when(t["text"].rlike(r"\S"), i).otherwise(-1))))
    out = out.withColumn("_last", at)
    own = F.flatten(F.filter(F.transform("_runs", lambda r, k: F.when(r["level"] == 0, F.filter(
        r["lines"], lambda t, i: ~((k < F.size("_runs") - 1) & (i == F.get("_last", k)) & t["text"].rlike(INTRO))))), lambda ls: ls.isNotNull()))
    quoted = F.transform(F.filter("_runs", lambda r: r["level"] > 0), lambda r: F.struct(r["level"].alias("level"), F.array_join(F.transform(r["lines"], lambda s: s["text"]), "\n").alias("text")))
    return out.withColumn("own", F.trim(F.regexp_replace(F.array_join(F.transform(own, lambda s: s["text"]), "\n"), r"^\s+|\s+$", ""))).withColumn("quotes", quoted).drop("_lines", "_first", "_runs", "_last")


def link(messages: DataFrame, box: str, number: str, body: str, role: str | None = None) -> DataFrame:
    """One row for each message: box, number, own, n_quotes, n_linked, parent, root and depth, after these the role if named.

    A message is known by mailbox and number; of rows that share both, the one with the
    smallest body counts. Rows without mailbox or number are left alone: no parent, root
    the message itself, depth 0. Parents are earlier messages, so there are no cycles.
    Blank passages link to nothing, ties go to the first message with the passage; a part
    of a message links if it has a whole paragraph of it, or a line or sentence of
    PIECE_CHARS letters or more. An empty table gives an empty one.
    """
    extra = ["role"] if role else []
    rows = messages.select(F.col(box).alias("box"), F.col(number).alias("msg"), F.col(body).alias("body"), *(F.col(role).alias(e) for e in extra))
    keyed = rows.where(F.col("box").isNotNull() & F.col("msg").isNotNull()).groupBy("box", "msg").agg(F.min("body").alias("body"), *(role_of_least("body", e) for e in extra))
    parsed = materialize(parse(keyed, "body").drop("body"), "parsed")
    def named(df, pieces, *columns):
        """The pieces of each row by their hash, with their lengths."""
        one = df.select(*columns, F.explode(pieces).alias("p")).where(normal(F.col("p")) != "")
        return one.select(*columns, _name(F.col("p")).alias("name"), F.length(normal(F.col("p"))).alias("chars"))

    def paragraphs(text):
        return F.split(text, r"\n\s*\n")

    def parts(text):
        """Lines, and sentences across lines, that are long enough."""
        sentences = F.flatten(F.transform(paragraphs(text), lambda p: F.split(normal(p), r"(?<=[.!?])\s+")))
        return F.filter(F.array_union(F.transform(F.split(text, "\n"), normal), sentences), lambda p: F.length(p) >= PIECE_CHARS)

    def first(pieces):
        return named(parsed, pieces, "box", "msg").groupBy("box", "name").agg(F.min("msg").alias("ref"))

    own = F.col("own")
    source = first(F.array_union(F.array(own), paragraphs(own)))
    quoted = parsed.select("box", "msg", F.posexplode("quotes").alias("at", "q")).where(normal(F.col("q.text")) != "").select("box", "msg", "at", F.col("q.level").alias("level"), F.col("q.text").alias("text"))
    passage = ["box", "msg", "at", "level"]
    whole = quoted.select(*passage, _name(F.col("text")).alias("name")).join(source, ["box", "name"]).where("ref < msg").select(*passage, "ref")
    links = materialize(whole, "links")
    # passages that are no whole text or paragraph: by what they are made of
    for pieces, held in ((paragraphs(F.col("text")), source), (parts(F.col("text")), None)):
        rest = materialize(quoted.join(links, ["box", "msg", "at"], "left_anti"), "rest")
        if rest.isEmpty():
            break
        met = named(rest, pieces, *passage).join(held if held is not None else first(parts(own)), ["box", "name"]).where("ref < msg")
        held_by = met.groupBy(*passage, "ref").agg(F.sum("chars").alias("chars"))
        # the message that holds most of it, of equal ones the first
        best = held_by.groupBy(*passage).agg(F.min_by("ref", F.struct((-F.col("chars")).alias("c"), F.col("ref").alias("r"))).alias("ref"))
        links = links.unionByName(materialize(best, "part-links"))
    parents = links.groupBy("box", "msg").agg(F.count("*").alias("n_linked"), F.max(F.struct((-F.col("level")).alias("near"), "ref"))["ref"].alias("parent"))
    state = parsed.join(parents, ["box", "msg"], "left").select(
        "box", "msg", "own", F.size("quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "parent", *extra)
    state = materialize(state, "linked")
    # a message is open while the top it knows of has a parent itself; only open ones jump, to the top of their top
    replies = state.where("parent is not null").select("box", F.col("msg").alias("top"), F.lit(True).alias("open"))
    up = state.select("box", "msg", F.coalesce("parent", "msg").alias("top"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    up = materialize(up.join(replies, ["box", "top"], "left").select("box", "msg", "top", "depth", (F.col("open").isNotNull() & (F.col("depth") > 0)).alias("open")), "up")
    while not up.where("open").isEmpty():
        step = up.select("box", F.col("msg").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"), F.col("open").alias("still"))
        moved = up.where("open").join(step, ["box", "top"]).select("box", "msg", F.col("next").alias("top"), (F.col("depth") + F.col("more")).alias("depth"), F.col("still").alias("open"))
        up = materialize(up.where(~F.col("open")).unionByName(moved), "up")
    out = state.join(up.drop("open"), ["box", "msg"]).select("box", "msg", "own", "n_quotes", "n_linked", "parent", F.col("top").alias("root"), "depth", *extra)
    alone = parse(rows.where(F.col("box").isNull() | F.col("msg").isNull()), "body").select(
        "box", "msg", "own", F.size("quotes").cast("long").alias("n_quotes"), F.lit(0).cast("long").alias("n_linked"), F.lit(None).cast(rows.schema["msg"].dataType).alias("parent"), F.col("msg").alias("root"), F.lit(0).cast("long").alias("depth"), *extra)
    return out.unionByName(alone).withColumnsRenamed({"box": box, "msg": number} | ({"role": role} if role else {}))


def role_of_least(body: str, role: str) -> Column:
    """The role of the row with the smallest body, null bodies last, then of the smallest role."""
    return F.min(F.struct(F.col(body).isNull().alias("none"), F.col(body).alias("body"), F.col(role).alias("role")))["role"].alias("role")


def conversations(messages: DataFrame, box: str, number: str, body: str, role: str) -> DataFrame:
    """What `link` returns, with `position`: the message's place in its thread, from 0.

    Ordered by box, root and position, `role` and `own` are the conversation without quotes.
    A message stands before its replies; replies to one message follow by number, each
    with all that answers it. Rows without mailbox or number stand at 0.
    """
    rows = materialize(link(messages, box, number, body, role).withColumnsRenamed({box: "box", number: "msg"}), "threads")
    known = rows.where(F.col("box").isNotNull() & F.col("msg").isNotNull()).select("box", "msg", "parent")
    replies = number_rows(known.where(F.col("parent").isNotNull()), ["box", "parent", "msg"], "at")
    replies = materialize(replies, "replies")
    before = replies.select("box", "parent", (F.col("at") + 1).alias("at"), F.col("msg").alias("before"))
    last = replies.groupBy("box", "parent").agg(F.max("msg").alias("last")).withColumnRenamed("parent", "msg")
    known = known.join(replies.join(before, ["box", "parent", "at"], "left").select("box", "msg", "before"), ["box", "msg"], "left").join(last, ["box", "msg"], "left")
    # a walk around each thread enters and leaves every message; each step names the step before it and the messages entered from there on
    enter = known.select("box", "msg", F.lit(False).alias("left"), F.coalesce("before", "parent").alias("to"), F.col("before").isNotNull().alias("to_left"),
                         F.when(F.col("parent").isNotNull() & F.col("before").isNull(), 1).otherwise(0).cast("long").alias("position"))
    leave = known.select("box", "msg", F.lit(True).alias("left"), F.coalesce("last", "msg").alias("to"), F.col("last").isNotNull().alias("to_left"),
                         F.when(F.col("last").isNull(), 1).otherwise(0).cast("long").alias("position"))
    walk = materialize(enter.unionByName(leave), "walk")
    while not walk.where("to is not null").isEmpty():
        step = walk.select("box", F.col("msg").alias("to"), F.col("left").alias("to_left"), F.col("to").alias("next"), F.col("to_left").alias("next_left"), F.col("position").alias("more"))
        moved = walk.where("to is not null").join(step, ["box", "to", "to_left"]).select(
            "box", "msg", "left", F.col("next").alias("to"), F.col("next_left").alias("to_left"), (F.col("position") + F.col("more")).alias("position"))
        walk = materialize(walk.where("to is null").unionByName(moved), "walk")
    place = walk.where(~F.col("left")).select("box", "msg", "position")
    return rows.join(place, ["box", "msg"], "left").withColumn("position", F.coalesce("position", F.lit(0)).cast("long")).withColumnsRenamed({"box": box, "msg": number})
