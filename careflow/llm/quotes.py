"""Quotation linking in conversations, in DataFrame functions only.

A message's lines are read into its own words and quoted passages of any level. Quoted passages, whole and line by line,
are normalised, hashed and joined to the earliest message of the conversation that says the same in its own words. What is
still unlinked then, such as some lines of a paragraph wrapped anew or a part of one line, is hashed by windows of words.
The links give each message the one it replies to, and the conversation is returned in reply order, without quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from careflow.llm.ranks import placed
from careflow.session import cut_lineage

QUOTE = r"^(?:[ \t]*>)+"
#: A line that only says who wrote what is quoted below it.
ATTRIBUTION = r"(?i)^(?:on .* wrote|.* (?:wrote|writes|schrieb|escribió|a écrit))[^:]{0,60}:$"
#: Its first line, where it is broken over two, and its second.
OPENS = r"(?i)^(?:on|am|le|el) [^!?]{0,120}[^.!?:]$"
CLOSES = r"(?i)^(?:[^!?]{0,120} )?(?:wrote|writes|schrieb|escribió|a écrit)[^:]{0,60}:$"
WINDOW = 5  # words of a window; a shorter passage is one window, but a single word isn't sought
KEY = ["conv_id", "turn"]


def quoted_lines(text: Column) -> Column:
    """array<struct<level, line>>: each line without its quote marks, and how many it had."""

    def one(line: Column) -> Column:
        marks = F.regexp_extract(line, QUOTE, 0)
        return F.struct(
            (F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))).alias("level"),
            F.trim(F.substr(line, F.length(marks) + 1)).alias("line"),
        )

    return F.transform(F.split(text, r"\r\n|\n|\r", -1), one)


def with_attributions(lines: Column) -> Column:
    """``lines`` with ``said_by``: whether a line, or two, of a lower level only say who wrote the quote right below."""

    def one(x: Column, i: Column) -> Column:
        level = lambda at: F.coalesce(F.get(lines, i + at)["level"], F.lit(0))
        like = lambda at, form: F.coalesce(F.get(lines, i + at)["line"].rlike(form), F.lit(False))
        first = like(0, OPENS) & like(1, CLOSES) & (level(1) == x["level"]) & (level(2) > x["level"])
        quote_below = level(1) > x["level"]
        before = F.when(i > 0, F.get(lines, i - 1))
        second = F.coalesce(before["line"].rlike(OPENS) & (before["level"] == x["level"]), F.lit(False)) & like(0, CLOSES)
        said_by = first | (quote_below & (like(0, ATTRIBUTION) | second))
        return F.struct(x["level"].alias("level"), x["line"].alias("line"), said_by.alias("said_by"))

    return F.transform(lines, one)


def own_lines(lines: Column) -> Column:
    """The lines of level 0, without attributions of the quote below them."""
    return F.transform(F.filter(lines, lambda x: (x["level"] == 0) & ~x["said_by"]), lambda x: x["line"])


def normal_words(text: Column) -> Column:
    """The words in lower case with one space between; signs and white space of any kind count as space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def passage_key(text: Column) -> Column:
    """Hash of a passage's words. Null without a word."""
    normal = normal_words(text)
    return F.when(normal != "", F.md5(normal))


def _windows(words: Column, size: Column) -> Column:
    """Hashes of all runs of ``size`` words, each once; none if there are fewer words."""
    last = F.size(words) - size + 1
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, size))))


def _units(passages: Column) -> Column:
    """Each passage, and each line of it, as array<struct<key, chars>>; without those that have no words."""
    units = F.array_distinct(F.concat(passages, F.flatten(F.transform(passages, lambda p: F.split(p, "\n", -1)))))
    keyed = F.transform(units, lambda u: F.struct(passage_key(u).alias("key"), F.length(u).alias("chars")))
    return F.filter(keyed, lambda u: u["key"].isNotNull())


def quoted_passages(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, row_hash, level, passage: maximal runs of lines of one quote level, in messages that quote.

    Attributions of deeper quotes are no part of a passage.
    """
    lines = parsed.select(*KEY, "row_hash", F.posexplode("lines").alias("pos", "x"))
    lines = lines.select(*KEY, "row_hash", "pos", "x.level", "x.line", "x.said_by")
    message = W.partitionBy(*KEY, "row_hash").orderBy("pos")
    changed = (F.col("level") != F.lag("level", 1, -1).over(message)).cast("int")
    runs = lines.withColumn("changed", changed).withColumn("run", F.sum("changed").over(message))
    runs = runs.where("level > 0 and not said_by").groupBy(*KEY, "row_hash", "run", "level")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return runs.agg(text.alias("passage")).drop("run")


def linked_by_windows(parsed: DataFrame, passages: DataFrame) -> DataFrame:
    """conv_id, turn, level, passage_hash, chars, o_turn: passages of which one message first said half of the windows or more.

    Every window has one first speaker, which is found by an aggregation, so no pairs of messages and passages are formed.
    Only windows that some passage has are kept of the messages.
    """
    words = F.split(normal_words(F.col("passage")), " ")
    sought = passages.withColumn("words", words).where(F.size("words") >= 2)
    sought = sought.withColumn("size", F.least(F.size("words"), F.lit(WINDOW)))
    sought = sought.withColumn("hashes", _windows(F.col("words"), F.col("size"))).withColumn("n", F.size("hashes"))
    name = [*KEY, "level", "passage_hash"]
    sought = cut_lineage(sought.select(*name, F.length("passage").alias("chars"), "size", "n", F.explode("hashes").alias("hash")))
    asked = sought.select(F.col("conv_id").alias("a_conv"), F.col("size").alias("a_size"), F.col("hash").alias("a_hash"))
    sizes = asked.select("a_conv", "a_size").distinct()
    own = parsed.join(sizes, F.col("conv_id").eqNullSafe(F.col("a_conv")))
    own = own.withColumn("words", F.split(normal_words(F.col("own")), " "))
    own = own.select(
        F.col("conv_id").alias("o_conv"),
        F.col("turn").alias("o_turn"),
        F.col("a_size").alias("o_size"),
        F.explode(_windows(F.col("words"), F.col("a_size"))).alias("o_hash"),
    )
    wanted = F.col("o_conv").eqNullSafe(F.col("a_conv")) & (F.col("o_size") == F.col("a_size")) & (F.col("o_hash") == F.col("a_hash"))
    own = own.join(asked.distinct(), wanted, "left_semi")
    first = own.groupBy("o_conv", "o_size", "o_hash").agg(F.min("o_turn").alias("o_turn"))
    same = F.col("conv_id").eqNullSafe(F.col("o_conv")) & (F.col("size") == F.col("o_size")) & (F.col("hash") == F.col("o_hash"))
    said = sought.join(first, same & (F.col("o_turn") < F.col("turn")))
    said = said.groupBy(*name, "chars", "n", "o_turn").agg(F.count("*").alias("met")).where(F.col("met") * 2 >= F.col("n"))
    return said.select(*name, F.floor(F.col("chars") * F.col("met") / F.col("n")).cast("int").alias("chars"), "o_turn")


def links(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, n_quotes, n_linked, max_level: one row per message that quotes."""
    quoting = parsed.where("quotes").select(*KEY, "row_hash", "lines").distinct()  # a repeated row quotes once
    passages = quoted_passages(quoting).withColumn("passage_hash", F.xxhash64("row_hash", "level", "passage"))
    passages = cut_lineage(passages.select(*KEY, "level", "passage_hash", "passage").distinct())
    units = passages.select(*KEY, "level", "passage_hash", F.inline(_units(F.array("passage")))).distinct()
    # only conversations in which somebody quotes; each passage's first speaker is one aggregated row
    asked = units.select(F.col("conv_id").alias("a_conv"), F.col("key").alias("a_key")).distinct()
    talks = asked.select("a_conv").distinct()
    own = parsed.join(talks, F.col("conv_id").eqNullSafe(F.col("a_conv")), "left_semi")
    own = own.select(*KEY, F.inline(_units(F.concat(F.array("own"), F.split("own", r"\n\s*\n", -1)))))
    first = own.groupBy(F.col("conv_id").alias("o_conv"), F.col("key").alias("o_key")).agg(F.min("turn").alias("o_turn"))
    said = units.join(
        first,
        F.col("conv_id").eqNullSafe(F.col("o_conv")) & (F.col("key") == F.col("o_key")) & (F.col("o_turn") < F.col("turn")),
        "left",
    )
    name = [*KEY, "level", "passage_hash"]
    said = cut_lineage(said.select(*name, "chars", "o_turn"))
    missed = said.groupBy(*name).agg(F.count("o_turn").alias("n")).where("n = 0")
    missed = missed.toDF(*(f"m_{c}" for c in name), "n")
    same = [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in name]
    said = cut_lineage(said.unionByName(linked_by_windows(parsed, passages.join(missed, same, "left_semi"))))
    # the nearest level that is linked at all, then the most text, then the later message
    score = said.where("o_turn is not null").groupBy(*KEY, "level", "o_turn").agg(F.sum("chars").alias("chars"))
    best = score.groupBy(*KEY).agg(F.max(F.struct(-F.col("level"), "chars", "o_turn")).alias("best"))
    linked = said.groupBy(*name).agg(F.count("o_turn").alias("n"))
    counts = linked.groupBy(*KEY).agg(
        F.count("*").alias("n_quotes"), F.count_if(F.col("n") > 0).alias("n_linked"), F.max("level").alias("max_level")
    )
    best = best.toDF("b_conv", "b_turn", "best")
    same = F.col("conv_id").eqNullSafe(F.col("b_conv")) & F.col("turn").eqNullSafe(F.col("b_turn"))
    return counts.join(best, same, "left").select(*KEY, F.col("best.o_turn").alias("reply_to"), *counts.columns[2:])


def threads(replies: DataFrame) -> DataFrame:
    """conv_id, turn, root, depth of every reply, by doubling the way up; a reply always points to an earlier turn.

    Each round is written and doubles the number of steps that all replies have gone, so the rounds grow with the
    logarithm of the longest chain.
    """
    up = cut_lineage(replies.select(*KEY, F.col("reply_to").alias("root"), F.lit(1).cast("long").alias("depth")))
    while True:
        above = up.toDF("a_conv", "a_turn", "a_root", "a_depth")
        same = F.col("conv_id").eqNullSafe(F.col("a_conv")) & (F.col("root") == F.col("a_turn"))
        climbed = up.join(above, same, "left").select(
            *KEY,
            F.coalesce("a_root", "root").alias("root"),
            (F.col("depth") + F.coalesce("a_depth", F.lit(0))).alias("depth"),
            F.col("a_root").isNotNull().alias("moved"),
        )
        climbed = cut_lineage(climbed)
        up = climbed.drop("moved")
        if climbed.where("moved").isEmpty():
            return up


def parsed_messages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, row_hash, quotes, own, lines: a row per message, with its own words; lines only where it quotes."""
    lines = quoted_lines(F.coalesce(F.col("text"), F.lit("")))
    # one column each time, so that it is computed once
    parsed = messages.select(*KEY, "role", F.xxhash64("role", "text").alias("row_hash"), F.explode(F.array(lines)).alias("lines"))
    parsed = parsed.withColumn("lines", F.explode(F.array(with_attributions(F.col("lines")))))
    quotes = F.exists("lines", lambda x: x["level"] > 0) & F.col("turn").isNotNull()
    own = F.array_join(own_lines(F.col("lines")), "\n")
    parsed = parsed.select(*KEY, "role", "row_hash", quotes.alias("quotes"), own.alias("own"), "lines")
    return parsed.withColumn("lines", F.when(F.col("quotes"), F.col("lines")))


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, position, reply_to, root, depth, n_quotes, n_linked, max_level, body; a row per message.

    ``body`` is the message without quotes and attributions (of one line or two), trimmed; ``reply_to`` the turn it quotes
    most at the lowest linked level, null if it quotes nothing said before. A passage is linked if it, or one of its lines,
    is a whole message, paragraph or line said before, or else if one message first said at least half of its windows of
    five words (all words, if there are only two to four). ``root`` and ``depth`` its place in the tree of replies.
    ``position`` (from 1) orders a conversation by root, depth and turn, so that every message follows the one it replies
    to. A null text has an empty body. Messages of the same conversation and turn share their links. Null conversation
    ids form a conversation; a message without a turn quotes nothing and is quoted by nobody, and comes last. Other
    columns are not looked at; an empty table gives an empty result.
    """
    parsed = cut_lineage(parsed_messages(messages))
    body = F.regexp_replace("own", r"^\s+|\s+$", "")
    bodies = parsed.select(*KEY, "role", "row_hash", body.alias("body"))
    if parsed.where("quotes").isEmpty():
        known = bodies.withColumns(
            {"reply_to": F.lit(None).cast(messages.schema["turn"].dataType), "root": F.col("turn"), "depth": F.lit(0).cast("long")}
            | {c: F.lit(0).cast("long") for c in ("n_quotes", "n_linked", "max_level")}
        )
    else:
        found = cut_lineage(links(parsed))
        ways = threads(found.where("reply_to is not null")).toDF("w_conv", "w_turn", "root", "depth")
        way = F.col("conv_id").eqNullSafe(F.col("w_conv")) & (F.col("turn") == F.col("w_turn"))
        facts = found.join(ways, way, "left").drop("w_conv", "w_turn").withColumnsRenamed({"conv_id": "f_conv", "turn": "f_turn"})
        same = F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("turn") == F.col("f_turn"))
        known = bodies.join(facts, same, "left").select(
            *bodies.columns,
            "reply_to",
            F.coalesce("root", "turn").alias("root"),
            *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("depth", "n_quotes", "n_linked", "max_level")),
        )
    order = [F.col("root").asc_nulls_last(), F.col("depth"), F.col("turn"), F.col("row_hash")]
    names = ["reply_to", "root", "depth", "n_quotes", "n_linked", "max_level", "body"]
    return placed(known, ["conv_id"], order).select(*KEY, "role", F.col("place").alias("position"), *names)
