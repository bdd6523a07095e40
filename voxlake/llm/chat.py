"""Chat formatting with Spark expressions only: one string and one loss mask for each conversation.

Template: a block for each run of adjacent turns of one role, ``### role: `` text ``</turn>`` and a line feed; turns that
a block merges stand apart by ``<next/>``. Inside texts and roles, a backslash and the control strings become ``\\b``,
``\\h``, ``\\t``, ``\\n`` (and ``\\c`` for a role's colon), so every backslash starts an escape and reading back is exact.
The loss mask is an array of (start, length) over code points, one for each assistant text.

Results for odd rows: a null text or role is empty; turns that tie stand by role, then text; repeated rows are turns of
their own; an empty text still is a turn; an empty table gives no row; a null conv_id is a conversation. Columns other
than conv_id, turn, role and text are not read. A conversation is one value of the result, so its turns meet in one row:
it must be shorter than Spark's 2 GB a value (500 million characters to be read back); no other group is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

OPEN, COLON, END, NEXT = "### ", ": ", "</turn>\n", "<next/>"
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"), ("<next/>", "\\n"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
TRAP = "\\### Assistant: </turn> ok"


def _escape(c: Column, pairs=ESCAPES) -> Column:
    for plain, mark in pairs:
        c = F.replace(c, F.lit(plain), F.lit(mark))
    return c


def _unescape(c: Column, pairs=ROLE_ESCAPES) -> Column:
    for plain, mark in reversed(pairs):
        c = F.replace(c, F.lit(mark), F.lit(plain))
    return c


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_mask. One shuffle by conversation; the turns are escaped before it.

    Neighbours and offsets come from windows over a conversation's turns in order, so the work is linear in them."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _escape(empty("role"), ROLE_ESCAPES).alias("role"), _escape(empty("text")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    beside = lambda f: F.coalesce(f("role").over(order) == F.col("role"), F.lit(False))
    rows = rows.select(
        "conv_id", "role", "text", F.row_number().over(order).alias("nth"),
        F.when(beside(F.lag), NEXT).otherwise(F.concat(F.lit(OPEN), "role", F.lit(COLON))).alias("head"), F.when(beside(F.lead), "").otherwise(END).alias("tail"),
    )
    width = (F.length("head") + F.length("text") + F.length("tail")).cast("long")
    before = F.coalesce(F.sum(width).over(Window.partitionBy("conv_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    span = F.when(F.col("role") == _escape(F.lit(loss_role), ROLE_ESCAPES), F.struct((before + F.length("head")).alias("start"), F.length("text").cast("long").alias("length")))
    pieces = rows.select("conv_id", F.struct("nth", F.concat("head", "text", "tail").alias("piece"), span.alias("span")).alias("t"))
    chats = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return chats.select("conv_id", F.array_join("turns.piece", "").alias("formatted"), F.filter("turns.span", lambda s: s.isNotNull()).alias("loss_mask"))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns as array of (role, text), and loss_text, from ``formatted`` and ``loss_mask`` alone."""
    blocks = F.split("formatted", END, -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)
    role = lambda b: F.substring_index(b, COLON, 1)
    body = lambda b: b.substr(F.length(role(b)) + len(COLON) + 1, F.length(b))
    own = lambda b: F.transform(F.split(body(b), NEXT, -1), lambda t: F.struct(_unescape(role(b).substr(F.lit(len(OPEN) + 1), F.length(b))).alias("role"), _unescape(t, ESCAPES).alias("text")))
    # places of bytes of UTF-32 are found at once; one character more is taken, since a first byte order mark would be lost
    part = lambda w, s: F.decode(F.substring(w, (4 * s["start"] - 3).cast("int"), (4 * s["length"] + 4).cast("int")), "UTF-32").substr(F.lit(2), s["length"].cast("int"))
    under = F.flatten(F.transform(F.array(F.encode("formatted", "UTF-32")), lambda w: F.transform("loss_mask", lambda s: _unescape(part(w, s), ESCAPES))))
    return chats.select("conv_id", "formatted", F.flatten(F.transform(blocks, own)).alias("turns"), F.array_join(under, "").alias("loss_text"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP).alias("text"))
    back = read_back(format_chats(rows.union(trap)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(replace(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t'), '<next/>', '\n')) AS n,
    lag(role) OVER w IS NOT DISTINCT FROM role AS again, lead(role) OVER w IS NOT DISTINCT FROM role AS more
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE WHEN again THEN 7 ELSE 6 + length(role) END + CASE WHEN more THEN 0 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
