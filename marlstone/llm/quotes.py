"""Quotation linking: reply structure of conversations from quoted passages, by DataFrame functions alone.

A line's quote level is the number of ``>`` that open it (white space between them allowed).  A passage is a maximal run of lines of one
level without a blank line; its normal form is lower case with runs of white space as one space.  Passages and their single lines are
hashed.  The original of a quoted passage is the earliest message of the same conversation, before the quoting one, that holds it
without quote marks; the parent of a message is the original that accounts for most quoted characters at level 1 (ties: the latest).
Deeper levels are links too (``n_links``), but make no parents.  Roots are found by pointer jumping over linked messages only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

_MARKS = r"^[ \t]*(?:>[ \t]*)+"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), "[^>]", ""))


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n\x0B\f]+", " "))


def parsed(text: Column) -> Column:
    """Passages of a text: array of (level, body, lines); blank lines part passages."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|\n|\r"), lambda x: F.struct(_level(x).alias("level"), F.regexp_replace(x, _MARKS, "").alias("body")))

    def runs(a: Column) -> Column:
        blank = lambda x: F.trim(x["body"]) == ""
        starts = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (F.get(a, i)["level"] != F.get(a, i - 1)["level"]) | (blank(F.get(a, i)) != blank(F.get(a, i - 1))))
        ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(a)))
        parts = F.zip_with(starts, ends, lambda s, e: F.slice(a, s + 1, e - s))
        sound = F.filter(parts, lambda p: ~blank(F.get(p, F.lit(0))))
        return F.transform(sound, lambda p: F.struct(F.get(p, F.lit(0))["level"].alias("level"), F.transform(p, lambda x: x["body"]).alias("lines")))

    return F.get(F.transform(F.array(lines), runs), F.lit(0))


def own_text(text: Column) -> Column:
    """The text without quoted lines, trimmed of outer white space; a text without quotes is returned as it is."""
    kept = F.filter(F.split(text, "\r\n|\n|\r"), lambda x: _level(x) == 0)
    return F.when(F.coalesce(text, F.lit("")).rlike(r"(?m)" + _MARKS), F.regexp_replace(F.array_join(kept, "\n"), r"^[ \t\n]+|[ \t\n]+$", "")).otherwise(F.coalesce(text, F.lit("")))


def _units(passages: DataFrame) -> DataFrame:
    """Hashes of passages and of single lines of longer ones, with their number of characters."""
    whole = F.array(F.array_join("lines", "\n"))
    units = F.when(F.size("lines") > 1, F.concat(whole, F.col("lines"))).otherwise(whole)
    out = passages.select("conv", "turn", "level", F.explode(F.transform(units, _normal)).alias("unit")).filter("unit <> ''")
    return out.select("conv", "turn", "level", F.sha2("unit", 256).alias("hash"), F.length("unit").alias("chars"))


def link(messages: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text (own words), n_quotes, n_links, parent_turn, root_turn, depth, position for each message.

    position is the place in the thread of the root, in reply order: a parent always has a smaller turn than its replies, so it stands
    before them.  Messages without a parent are their own roots, of depth 0 and position 0.  Null conversation, turn or text: the message
    is returned, without links (null text as empty).  Messages that repeat a (conversation, turn) share one place in the structure.
    A quote without a known original has no link.  An empty table gives no rows; other columns are not read.
    """
    slim = messages.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    has_mark = F.col("text").rlike(r"(?m)" + _MARKS)
    quoting = slim.filter(has_mark & F.col("conv").isNotNull() & F.col("turn").isNotNull())
    passages = lambda df: df.select("conv", "turn", F.explode(parsed(F.col("text"))).alias("p")).select("conv", "turn", "p.level", "p.lines")
    quotes = _units(passages(quoting).filter("level > 0")).groupBy("conv", "turn", "level", "hash").agg(F.max("chars").alias("chars"))
    quotes, _ = C.store(quotes, "quotes")
    # only conversations that quote need originals; the earliest message of each hash is one row a (conversation, hash)
    convs = quotes.select("conv").distinct()
    first = _units(passages(slim.filter(F.col("turn").isNotNull()).join(convs, "conv", "left_semi")).filter("level = 0")).groupBy("conv", "hash").agg(F.min("turn").alias("source"))
    links = quotes.join(first, ["conv", "hash"]).filter("source < turn")
    votes = links.groupBy("conv", "turn", "level", "source").agg(F.sum("chars").alias("chars"))
    votes, _ = C.store(votes, "votes")
    parents = votes.filter("level = 1").groupBy("conv", "turn").agg(F.max(F.struct("chars", "source")).alias("best")).select("conv", "turn", F.col("best.source").alias("parent"))
    counts = votes.groupBy("conv", "turn").agg(F.count("*").alias("n_links"))
    parents, _ = C.store(parents, "parents")
    # pointer jumping: after k rounds each linked message knows its ancestor 2**k steps up, or its root
    chain = parents.select("conv", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth"))
    while True:
        up = chain.select("conv", F.col("turn").alias("root"), F.col("root").alias("over"), F.col("depth").alias("more"))
        chain, _ = C.store(chain.join(up, ["conv", "root"], "left").select("conv", "turn", F.coalesce("over", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("over").isNotNull().alias("moved")), "chain")
        if chain.filter("moved").isEmpty():
            break
        chain = chain.drop("moved")
    # roots stand at 0; a window is as long as its thread
    placed = chain.drop("moved").withColumn("position", F.row_number().over(Window.partitionBy("conv", "root").orderBy("turn")))
    known = counts.join(parents, ["conv", "turn"], "left").join(placed, ["conv", "turn"], "left")
    n_quotes = F.when(has_mark, F.size(F.filter(parsed(F.col("text")), lambda p: p["level"] > 0))).otherwise(0)
    out = slim.select("conv", "turn", "role", own_text(F.col("text")).alias("text"), n_quotes.cast("long").alias("n_quotes")).join(known, ["conv", "turn"], "left")
    return out.select(F.col("conv").alias("conv_id"), "turn", "role", "text", "n_quotes", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("position", F.lit(0)).cast("long").alias("position"))


def conversations(linked: DataFrame) -> DataFrame:
    """conv_id, root_turn, n_messages, messages: the threads of link()'s rows, each an array of (position, turn, role, text, parent_turn,
    depth) in reply order, texts without quotes.  Messages of null conversation or turn belong to none."""
    sound = linked.filter("conv_id is not null and turn is not null")
    message = F.struct("position", "turn", "role", "text", "parent_turn", "depth")
    return sound.groupBy("conv_id", "root_turn").agg(F.count("*").alias("n_messages"), F.sort_array(F.collect_list(message)).alias("messages"))


#: The same in SQL, over a table ``conversations``.
SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
l AS (SELECT rid, conv_id, turn, i, list_extract(string_split_regex(text, '\r\n|\n|\r'), i) AS line FROM m, LATERAL (SELECT unnest(generate_series(1, len(string_split_regex(text, '\r\n|\n|\r')))) AS i)),
q AS (SELECT rid, conv_id, turn, i, line, length(regexp_replace(regexp_extract(line, '^[ \t]*(?:>[ \t]*)+'), '[^>]', '', 'g')) AS level, regexp_replace(line, '^[ \t]*(?:>[ \t]*)+', '') AS body FROM l),
r AS (SELECT *, CASE WHEN lag(level) OVER w IS DISTINCT FROM level OR (lag(trim(body)) OVER w = '') IS DISTINCT FROM (trim(body) = '') THEN 1 ELSE 0 END AS edge FROM q WINDOW w AS (PARTITION BY rid ORDER BY i)),
s AS (SELECT *, sum(edge) OVER (PARTITION BY rid ORDER BY i) AS run FROM r),
p AS (SELECT rid, conv_id, turn, level, run, string_agg(body, chr(10) ORDER BY i) AS body, count(*) AS n, list(body ORDER BY i) AS bodies FROM s WHERE trim(body) <> '' GROUP BY ALL),
u AS (SELECT rid, conv_id, turn, level, body FROM p UNION ALL SELECT rid, conv_id, turn, level, unnest(bodies) FROM p WHERE n > 1),
h AS (SELECT conv_id, turn, level, trim(regexp_replace(lower(body), '[ \t\r\n\x0B\f]+', ' ', 'g')) AS unit FROM u WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
quotes AS (SELECT DISTINCT conv_id, turn, level, unit FROM h WHERE level > 0 AND unit <> ''),
firsts AS (SELECT conv_id, unit, min(turn) AS source FROM h WHERE level = 0 AND unit <> '' GROUP BY ALL),
votes AS (SELECT q.conv_id, q.turn, level, source, sum(length(q.unit)) AS chars FROM quotes q JOIN firsts f ON q.conv_id = f.conv_id AND q.unit = f.unit AND source < q.turn GROUP BY ALL),
parents AS (SELECT conv_id, turn, max(struct_pack(chars := chars, source := source)).source AS parent FROM votes WHERE level = 1 GROUP BY ALL),
up AS (SELECT conv_id, turn, parent AS root, 1 AS depth FROM parents UNION ALL SELECT up.conv_id, up.turn, p.parent, depth + 1 FROM up JOIN parents p ON p.conv_id = up.conv_id AND p.turn = up.root),
roots AS (SELECT conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM up GROUP BY ALL),
places AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, root ORDER BY turn) AS position FROM roots),
own AS (SELECT rid, string_agg(line, chr(10) ORDER BY i) FILTER (level = 0) AS kept, bool_or(level > 0) AS quoted FROM q GROUP BY ALL),
n AS (SELECT rid, count(*) AS n_quotes FROM p WHERE level > 0 GROUP BY ALL),
c AS (SELECT conv_id, turn, count(*) AS n_links FROM votes GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role,
    CASE WHEN own.quoted THEN regexp_replace(coalesce(own.kept, ''), '^[ \t\n]+|[ \t\n]+$', '', 'g') ELSE m.text END AS text,
    coalesce(n.n_quotes, 0)::BIGINT AS n_quotes, coalesce(c.n_links, 0)::BIGINT AS n_links, parents.parent::BIGINT AS parent_turn,
    coalesce(roots.root, m.turn)::BIGINT AS root_turn, coalesce(roots.depth, 0)::BIGINT AS depth, coalesce(places.position, 0)::BIGINT AS position
FROM m LEFT JOIN own USING (rid) LEFT JOIN n USING (rid) LEFT JOIN c ON c.conv_id = m.conv_id AND c.turn = m.turn
    LEFT JOIN parents ON parents.conv_id = m.conv_id AND parents.turn = m.turn LEFT JOIN roots ON roots.conv_id = m.conv_id AND roots.turn = m.turn
    LEFT JOIN places ON places.conv_id = m.conv_id AND places.turn = m.turn
"""
