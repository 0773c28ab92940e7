"""Chat formatting: quotation linking. DataFrame functions only.

Every line's leading ``>`` marks give its quote level. A message's own lines, and its own text as a whole, are normalised (lower case, single
spaces) and hashed; so are, at every level, the lines, the contiguous passages and the whole that it quotes. A quoted hash is linked to the latest earlier message of
the conversation that has it: an as-of search over the hash's turns in order, by ranges of them, never pairs of all that share it. The message that accounts for most quoted characters (the
latest of equals) at the shallowest level that has a match is the one replied to. Threads are found by pointer doubling, and messages are put in reply order: by their thread's first turn, then by turn,
with a gapless position. Only the position needs a sort; it is made by ranges, so no conversation has to fit in a task.

Defined cases: a null text counts as empty; null turns, and rows with a null conv_id, are kept but link to nothing (their thread is their turn); of rows with the same conv_id
and turn each is kept, but they count as one message in links; quotes whose original isn't found are removed all the same; an empty table gives an empty
result; other columns are carried if their names don't clash with the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, spill

MARK = r"^[ \t]*((?:>[ \t]?)+)"
ADDED = ("reply_to", "thread", "depth", "quote_levels", "n_quoted_lines", "position")


def normal(line: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(line), F.lit(r"[ \t\r\n\f\x0B]+"), F.lit(" ")))


def parse(messages: DataFrame) -> DataFrame:
    """Adds __lines: array of (level, body)."""
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARK, 1), F.lit(r"[^>]"), F.lit("")))
    lines = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, F.lit(MARK), F.lit("")).alias("body")))
    return messages.withColumn("__lines", lines)


def _join(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: x["body"]), "\n")


def _hash_texts(texts: Column) -> Column:
    """(hash, length) of each text, normalised; blank ones left out."""
    every = F.filter(F.array_distinct(F.transform(texts, normal)), lambda t: t != "")
    return F.transform(every, lambda t: F.struct(F.xxhash64(t, F.lit(1)).alias("h"), F.xxhash64(t, F.lit(2)).alias("h2"), F.length(t).alias("n")))


def _hashes(lines: Column) -> Column:
    """Those of each line and of the whole."""
    return _hash_texts(F.concat(F.transform(lines, lambda x: x["body"]), F.array(_join(lines))))


def _quoted_hashes(lines: Column, level: Column) -> Column:
    """Those of each line, each contiguous passage (with deeper quotes in it left out, and ended by them) and the whole of a level."""
    at = F.filter(lines, lambda x: x["level"] == level)
    runs = lambda some: F.split(F.array_join(F.transform(some, lambda x: F.when(x["level"] == level, x["body"]).otherwise("\x00")), "\n"), "\x00")
    return _hash_texts(F.concat(F.transform(at, lambda x: x["body"]), runs(lines), runs(F.filter(lines, lambda x: x["level"] <= level)), F.array(_join(at))))


def link(messages: DataFrame) -> DataFrame:
    """``messages`` with ``text`` free of quotes and the columns of ADDED."""
    columns = [c for c in messages.columns if c not in ADDED]
    rows = parse(messages.select(*columns))
    own = F.filter("__lines", lambda x: x["level"] == 0)
    rows = rows.withColumn("__own", own).withColumn("__quoted", F.filter("__lines", lambda x: x["level"] > 0))
    threads = thread_roots(reply_targets(rows)).withColumnsRenamed({c: f"__{c}" for c in ("parent", "root", "depth")})
    text = F.when(F.size("__quoted") == 0, F.coalesce(F.col("text"), F.lit(""))).otherwise(F.btrim(_join(F.col("__own")), F.lit("\n")))
    levels = F.coalesce(F.array_max(F.transform("__quoted", lambda x: x["level"])), F.lit(0))
    plain = rows.select(*[text.alias("text") if c == "text" else F.col(c) for c in columns], levels.alias("quote_levels"), F.size("__quoted").alias("n_quoted_lines"))
    done = join_small(plain, threads, ["conv_id", "turn"], "left")
    done = done.select(*columns, F.col("__parent").alias("reply_to"), F.coalesce("__root", "turn").alias("thread"), F.coalesce("__depth", F.lit(0).cast("long")).alias("depth"), "quote_levels", "n_quoted_lines")
    return positions(done)


def reply_targets(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, parent) of the messages that reply to an earlier turn."""
    place = ["conv_id", "h", "h2"]
    known = rows.where("conv_id is not null and turn is not null")
    levels = F.array_distinct(F.transform("__quoted", lambda x: x["level"]))
    asked = known.where(F.size("__quoted") > 0).select("conv_id", "turn", "__lines", F.explode(levels).alias("level"))
    asked = asked.select("conv_id", "turn", "level", F.explode(_quoted_hashes(F.col("__lines"), F.col("level"))).alias("q"))
    asked = spill(asked.select("conv_id", "turn", "level", "q.h", "q.h2", "q.n"), "quotes-asked")
    # Of all messages' lines only those that someone quotes are kept.
    units = known.select("conv_id", "turn", F.explode(_hashes(F.col("__own"))).alias("q")).select("conv_id", "turn", "q.h", "q.h2")
    units = join_small(units, asked.select(*place).distinct(), place, "left_semi").distinct()
    both = asked.withColumn("source", F.lit(None).cast("long")).unionByName(units.select(*place, "turn", F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("n"), F.col("turn").cast("long").alias("source")))
    # At one turn questions come before answers, so a message never answers itself. Ranges cut a passage that a whole conversation quotes; the latest source of the
    # ranges before goes on into the next one.
    order = [*place, "turn", F.col("source").asc_nulls_first()]
    ranged = spill(both.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "quotes-turns")
    here = Window.partitionBy("__range", *place).orderBy("turn", F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    last = ranged.groupBy("__range", *place).agg(F.max("source").alias("latest"))
    ahead = Window.partitionBy(*place).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = spill(last.withColumn("carried", F.max("latest").over(ahead)).where("carried is not null").drop("latest"), "quotes-carried")
    local = ranged.withColumn("parent", F.last("source", ignorenulls=True).over(here)).where("source is null")
    found = join_small(local, carried, ["__range", *place], "left").withColumn("parent", F.coalesce("parent", "carried")).where("parent is not null")
    votes = found.groupBy("conv_id", "turn", "level", "parent").agg(F.sum("n").alias("n"))
    return votes.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("shallow"), "n", "parent"))["parent"].alias("parent"))


def thread_roots(links: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, root, depth): pointer doubling over the links, as many rounds as the logarithm of the longest chain. Only messages whose pointer moved go
    on: those that have come to their thread's first message, however many they are, aren't looked up again."""
    state = spill(links.select("*", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth"), F.lit(True).alias("moved")), "quotes-links")
    while True:
        up = state.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        joined = state.where("moved").join(up, ["conv_id", "root"], "left")
        went = joined.select("conv_id", "turn", "parent", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved"))
        state = spill(went.unionByName(state.where("not moved")), "quotes-links")
        if not state.where("moved").limit(1).count():
            return state.drop("moved")


def positions(rows: DataFrame) -> DataFrame:
    """Gapless numbers from 0 in each conversation, by (thread, turn). Rows are dealt by ranges, sorted and numbered there, and stored with these numbers; a
    conversation's rows in a range are shifted by its rows in the ranges before."""
    columns = rows.columns
    order = ["conv_id", "thread", "turn", "__tie"]
    ranged = rows.withColumn("__tie", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = spill(ranged.select(*columns, F.monotonically_increasing_id().alias("__id"), F.spark_partition_id().alias("__range")), "quotes-ranges")
    sizes = ranged.groupBy("conv_id", "__range").agg(F.count(F.lit(1)).alias("size"), F.min("__id").alias("first"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("conv_id").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A null conversation has a key of its own, so that the join finds it.
    key = lambda c: F.struct(c.isNull().alias("none"), F.coalesce(c.cast("string"), F.lit("")).alias("v"))
    shifts = spill(sizes.select(key(F.col("conv_id")).alias("__key"), "__range", (before - F.col("first")).alias("__shift")), "quotes-shifts")
    joined = join_small(ranged.withColumn("__key", key(F.col("conv_id"))), shifts, ["__key", "__range"], "inner")
    return joined.select(*columns, (F.col("__id") + F.col("__shift")).cast("long").alias("position"))


SQL = r"""
    WITH RECURSIVE msg AS (SELECT row_number() OVER () AS r, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
    line AS (
        SELECT r, conv_id, turn, i, length(regexp_replace(regexp_extract(l, '^[ \t]*((?:>[ \t]?)+)', 1), '[^>]', '', 'g')) AS level, regexp_replace(l, '^[ \t]*((?:>[ \t]?)+)', '') AS body
        FROM (SELECT *, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM msg)),
    own AS (SELECT r, string_agg(body, chr(10) ORDER BY i) AS body FROM line WHERE level = 0 GROUP BY r),
    lv AS (SELECT r, min(level) AS top, max(level) AS levels, count(*) AS n FROM line WHERE level > 0 GROUP BY r),
    raw_units AS (SELECT r, conv_id, turn, body FROM line WHERE level = 0 UNION ALL SELECT r, conv_id, turn, own.body FROM own JOIN msg USING (r)),
    units AS (SELECT DISTINCT conv_id, turn, trim(regexp_replace(lower(body), '[ \t\r\n\f\v]+', ' ', 'g')) AS t FROM raw_units),
    -- At each level the lines, the runs that lines of other levels end, those that only shallower ones end, and the whole.
    at_levels AS (
        SELECT line.*, l.level AS l, count(*) FILTER (WHERE line.level <> l.level) OVER w AS ended, count(*) FILTER (WHERE line.level < l.level) OVER w AS left_out
        FROM line JOIN (SELECT DISTINCT r, level FROM line WHERE level > 0) l USING (r) WINDOW w AS (PARTITION BY r, l.level ORDER BY i)),
    quoted AS (SELECT * FROM at_levels WHERE level = l),
    raw_quotes AS (
        SELECT r, conv_id, turn, l, body FROM quoted
        UNION ALL SELECT r, any_value(conv_id), any_value(turn), l, string_agg(body, chr(10) ORDER BY i) FROM quoted GROUP BY r, l
        UNION ALL SELECT r, any_value(conv_id), any_value(turn), l, string_agg(body, chr(10) ORDER BY i) FROM quoted GROUP BY r, l, ended
        UNION ALL SELECT r, any_value(conv_id), any_value(turn), l, string_agg(body, chr(10) ORDER BY i) FROM quoted GROUP BY r, l, left_out),
    quotes AS (SELECT DISTINCT r, conv_id, turn, l, trim(regexp_replace(lower(body), '[ \t\r\n\f\v]+', ' ', 'g')) AS t FROM raw_quotes),
    found AS (SELECT q.r, q.conv_id, q.turn, q.l, q.t, max(u.turn) AS parent FROM quotes q JOIN units u ON q.conv_id = u.conv_id AND q.t = u.t AND u.turn < q.turn WHERE q.t <> '' GROUP BY ALL),
    votes AS (SELECT r, conv_id, turn, l, parent, sum(length(t)) AS n FROM found GROUP BY ALL),
    links AS (SELECT r, conv_id, turn, arg_max(parent, (-l, n, parent)) AS parent FROM votes GROUP BY ALL),
    up AS (SELECT conv_id, turn, min(parent) AS parent FROM links GROUP BY ALL),
    walk AS (
        SELECT r, conv_id, parent AS root, 1 AS depth FROM links
        UNION ALL SELECT w.r, w.conv_id, up.parent, w.depth + 1 FROM walk w JOIN up ON w.conv_id = up.conv_id AND w.root = up.turn),
    threads AS (SELECT r, arg_max(root, depth) AS root, max(depth) AS depth FROM walk GROUP BY r),
    done AS (
        SELECT msg.r, msg.conv_id, msg.turn, role, CASE WHEN lv.n IS NULL THEN text ELSE trim(coalesce(own.body, ''), chr(10)) END AS text, links.parent AS reply_to, coalesce(root, msg.turn) AS thread,
               coalesce(depth, 0)::BIGINT AS depth, coalesce(levels, 0)::INTEGER AS quote_levels, coalesce(lv.n, 0)::INTEGER AS n_quoted_lines
        FROM msg LEFT JOIN own USING (r) LEFT JOIN lv USING (r) LEFT JOIN links USING (r) LEFT JOIN threads USING (r))
    SELECT conv_id, turn, role, text, reply_to, thread, depth, quote_levels, n_quoted_lines, row_number() OVER (PARTITION BY conv_id ORDER BY thread, turn, r) - 1 AS position FROM done"""
