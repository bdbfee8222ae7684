"""Quotation linking: messages without their quotes, each linked to the message that it answers. DataFrame operations only.

A line's quote level is the number of leading ``>``. Quoted lines, normalised and hashed, are joined to the own lines
of earlier messages of their conversation; of an own line said often only the first message counts, so a common
line costs no pairs. A message answers the one that most of its outermost quoted lines come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import cut

MARK = r"^(?:[ \t]*>)+"
#: Lines that announce a quote, just before it.
SAYS = r"(?i)^.{0,200}\b(wrote|writes|said|schrieb|a écrit|escribió)\b.{0,80}:\s*$"


def _lines(text: Column) -> Column:
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), r"\n"),
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, MARK, 0), "[^>]", "")).alias("level"),
            F.regexp_replace(x, MARK + r"[ \t]?", "").alias("said"),
        ),
    )


def normal(line: Column) -> Column:
    """A line as it is compared: lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(line), r"\s+", " "))


def parse(messages: DataFrame) -> DataFrame:
    """``messages`` with _lines (level, said) and own: the text without quotes and the lines that announce them."""
    lines = messages.withColumn("_lines", _lines(F.col("text")))
    quoted = F.exists("_lines", lambda x: x["level"] > 0)

    def is_own(x: Column, i: Column) -> Column:
        after = F.get(F.col("_lines"), i + 1)["level"]
        return (x["level"] == 0) & ~((F.coalesce(after, F.lit(0)) > 0) & x["said"].rlike(SAYS))

    kept = F.array_join(F.transform(F.filter("_lines", is_own), lambda x: x["said"]), "\n")
    return lines.withColumn("own", F.when(quoted, F.trim(kept)).otherwise(F.col("text")))


def link(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, reply_to, n_quoted, n_linked, text), a row for each message, in reply order.

    reply_to: the earlier turn that most outermost quoted lines come from (ties: the latest); without one, turn - 1 if
    the conversation has it, else null. Sorting by conversation, reply_to (null first) and turn puts every message
    after the one it answers. Null texts stay null and quote nothing; rows that repeat a conversation and turn each
    give a row, and own lines of either can be quoted; null ids or turns are never linked; other columns are not read.
    An empty table gives an empty one.
    """
    base = cut(parse(messages.select("conv_id", "turn", "role", "text")))
    quoting = base.where(F.exists("_lines", lambda x: x["level"] > 0)).select("conv_id", "turn", F.xxhash64("text").alias("_row"), "_lines").dropDuplicates(["conv_id", "turn", "_row"])
    quotes = quoting.select("conv_id", "turn", "_row", F.explode("_lines").alias("l")).where("l.level > 0").select("conv_id", "turn", "_row", F.col("l.level").alias("level"), normal(F.col("l.said")).alias("n")).where("n <> ''")
    quotes = quotes.groupBy("conv_id", "turn", "_row", "level", "n").agg(F.count("*").alias("times"))
    asked = quotes.select("conv_id").distinct()
    own = base.join(asked, "conv_id", "left_semi").select("conv_id", "turn", F.explode(F.split("own", r"\n")).alias("l")).select("conv_id", "turn", normal(F.col("l")).alias("n")).where("n <> ''")
    first = own.groupBy("conv_id", F.xxhash64("n").alias("h"), F.length("n").alias("c")).agg(F.min("turn").alias("source"))
    found = quotes.withColumn("h", F.xxhash64("n")).withColumn("c", F.length("n")).join(first, ["conv_id", "h", "c"], "left").withColumn("source", F.expr("if(source < turn, source, null)"))
    votes = found.groupBy("conv_id", "turn", "_row", "source").agg(F.sum("times").alias("lines"), F.sum(F.when(F.col("level") == 1, F.col("times")).otherwise(0)).alias("outer_lines"))
    best = F.max(F.when(F.col("source").isNotNull() & (F.col("outer_lines") > 0), F.struct("outer_lines", "source")))
    linked = votes.groupBy("conv_id", "turn", "_row").agg(F.sum("lines").alias("n_quoted"), F.sum(F.when(F.col("source").isNotNull(), F.col("lines")).otherwise(0)).alias("n_linked"), best.alias("_best"))
    said = base.select("conv_id", "turn").distinct().select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"))
    rows = base.withColumn("_row", F.xxhash64("text")).drop("_lines", "text")
    out = rows.join(linked, ["conv_id", "turn", "_row"], "left").join(said, (F.col("conv_id") == F.col("_c")) & (F.col("turn") - 1 == F.col("_t")), "left")
    return out.select(
        "conv_id", "turn", "role", F.coalesce("_best.source", "_t").alias("reply_to"),
        F.coalesce("n_quoted", F.lit(0)).cast("bigint").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), F.col("own").alias("text"),
    ).sort("conv_id", "reply_to", "turn")


ORACLE = r"""
WITH m AS (SELECT row_number() OVER () AS mid, * FROM (SELECT DISTINCT conv_id, turn, text FROM conversations)),
x AS (SELECT mid, conv_id, turn, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM m),
l AS (SELECT mid, conv_id, turn, text, i, length(regexp_replace(regexp_extract(ls[i], '^([ \t]*>)+'), '[^>]', '', 'g')) AS level, regexp_replace(ls[i], '^([ \t]*>)+[ \t]?', '') AS said FROM x, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)),
n AS (SELECT *, coalesce(lead(level) OVER (PARTITION BY mid ORDER BY i), 0) AS after FROM l),
o AS (SELECT mid, bool_or(level > 0) AS quotes, coalesce(string_agg(said, chr(10) ORDER BY i) FILTER (level = 0 AND NOT (after > 0 AND regexp_matches(said, '(?i)^.{0,200}\b(wrote|writes|said|schrieb|a écrit|escribió)\b.{0,80}:\s*$'))), '') AS kept FROM n GROUP BY mid),
w AS (SELECT m.*, CASE WHEN quotes THEN trim(kept) ELSE text END AS own FROM m JOIN o USING (mid)),
f AS (SELECT conv_id, n, min(turn) AS source FROM (SELECT conv_id, turn, trim(regexp_replace(lower(unnest(string_split(own, chr(10)))), '\s+', ' ', 'g')) AS n FROM w) WHERE n <> '' GROUP BY ALL),
q AS (SELECT mid, conv_id, turn, level, trim(regexp_replace(lower(said), '\s+', ' ', 'g')) AS n FROM l WHERE level > 0),
v AS (SELECT q.mid, CASE WHEN f.source < q.turn THEN f.source END AS source, count(*) AS lines, count(*) FILTER (level = 1) AS outer_lines FROM q LEFT JOIN f ON f.conv_id = q.conv_id AND f.n = q.n WHERE q.n <> '' GROUP BY ALL),
b AS (SELECT mid, sum(lines)::BIGINT AS n_quoted, coalesce(sum(lines) FILTER (source IS NOT NULL), 0)::BIGINT AS n_linked, arg_max(source, (outer_lines, source)) FILTER (source IS NOT NULL AND outer_lines > 0) AS best FROM v GROUP BY mid)
SELECT c.conv_id, c.turn, c.role, coalesce(b.best, p.turn) AS reply_to, coalesce(b.n_quoted, 0) AS n_quoted, coalesce(b.n_linked, 0) AS n_linked, w.own AS text
FROM conversations c JOIN w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.turn IS NOT DISTINCT FROM c.turn AND w.text IS NOT DISTINCT FROM c.text LEFT JOIN b USING (mid)
LEFT JOIN (SELECT DISTINCT conv_id, turn FROM conversations) p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
"""
