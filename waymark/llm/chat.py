"""Chat formatting with a grammar round trip, in DataFrame functions only.

    conversation = turn*
    turn         = "<s>[INST] " role " " flag " [/INST]" body "</s>"

`flag` is 0 for a body as it stands and 1 for an escaped one. The parser cuts at "</s>" and takes
a turn only if its header has this form and its body holds no control string. A conversation is
first rendered with every flag 0 and parsed; the turns that do not come back as they were are
escaped, and the result is parsed again, which must give back the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings of the template.
BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]"
HEADER = r"^<s>\[INST\] ([^\x5B]*) ([01]) \[/INST\]"

#: Reversible escapes: an escaped body holds no "<" and no "[", so no control string.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def render_turn(role: Column, text: Column, flag: Column) -> Column:
    body = F.when(flag == "1", escape(text)).otherwise(text)
    return F.concat(F.lit(f"{BEGIN}{OPEN} "), role, F.lit(" "), flag, F.lit(f" {CLOSE}"), body, F.lit(END))


def parse(formatted: Column) -> Column:
    """array<struct<role, flag, body, text>>; a segment that is no turn gives a null role and text."""
    segments = F.split(formatted, END)
    turns = F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0)))

    def turn(s: Column) -> Column:
        flag = F.regexp_extract(s, HEADER, 2)
        body = F.regexp_replace(s, HEADER, "")
        sound = (flag != "") & ~body.rlike(CONTROL)
        return F.struct(
            F.when(sound, unescape(F.regexp_extract(s, HEADER, 1))).alias("role"),
            flag.alias("flag"),
            body.alias("body"),
            F.when(sound, F.when(flag == "1", unescape(body)).otherwise(body)).alias("text"),
        )

    return F.transform(turns, turn)


def format_conversations(df: DataFrame) -> DataFrame:
    """One row per conversation of df (conv_id, turn, role, text; other columns are left out).

    Columns: conv_id, formatted, turns (as parsed back from `formatted`: role, flag, body, text)
    and loss_spans (start and end offsets in `formatted`, in code points, of each assistant
    body). Turns are ordered by turn, then role and text where turns repeat; a null role or text
    counts as empty; rows with a null conv_id form one conversation; an empty table gives no rows.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    source = df.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("source"))

    def render(flag_of) -> Column:
        # roles are escaped at all times, so that a header always has its form
        return F.array_join(F.transform("source", lambda t: render_turn(escape(t["role"]), t["text"], flag_of(t))), "")

    def same(turns: Column) -> Column:
        plain = lambda xs: F.transform(xs, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
        return plain(turns) == plain(F.col("source"))

    plain = source.withColumn("formatted", render(lambda t: F.lit("0"))).withColumn("back", parse(F.col("formatted")))
    # a turn conflicts if, rendered alone, it is not parsed back as it was
    alone = lambda t: parse(render_turn(escape(t["role"]), t["text"], F.lit("0")))
    conflicts = lambda t: (F.size(alone(t)) != 1) | ~F.coalesce(F.get(alone(t), F.lit(0))["text"].eqNullSafe(t["text"]), F.lit(False))
    clean = F.coalesce(same(F.col("back")), F.lit(False))
    mended = plain.withColumn("formatted", F.when(clean, F.col("formatted")).otherwise(render(lambda t: F.when(conflicts(t), "1").otherwise("0"))))
    parsed = mended.select("conv_id", "source", "formatted", parse(F.col("formatted")).alias("turns"))
    sound = F.coalesce(same(F.col("turns")), F.lit(False))
    checked = parsed.withColumn("turns", F.when(sound, F.col("turns")).otherwise(F.raise_error(F.lit("a conversation does not survive its round trip"))))

    shell = len(f"{BEGIN}{OPEN}   {CLOSE}") + 1  # of a header, without its role
    start = lambda done, t: done["at"] + shell + F.length(escape(t["role"]))
    step = lambda done, t: F.struct(
        (start(done, t) + F.length(t["body"]) + len(END)).alias("at"),
        F.when(t["role"] == "assistant", F.concat(done["spans"], F.array(F.struct(start(done, t).alias("start"), (start(done, t) + F.length(t["body"])).alias("end"))))).otherwise(done["spans"]).alias("spans"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))
    return checked.select("conv_id", "formatted", "turns", F.aggregate("turns", zero, step, lambda done: done["spans"]).alias("loss_spans"))


def digest(formatted: DataFrame) -> DataFrame:
    """The report of op6, read back from the formatted text: bodies under the loss mask are cut out of it and unescaped."""
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    flags = F.filter("turns", lambda t: t["role"] == "assistant")
    cut = F.zip_with("loss_spans", flags, lambda s, t: F.struct(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]).alias("body"), t["flag"].alias("flag")))
    loss = F.array_join(F.transform(cut, lambda t: F.when(t["flag"] == "1", unescape(t["body"])).otherwise(t["body"])), "")
    return formatted.withColumn("_loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The same rows in DuckDB; what the template adds to a turn and its escapes is counted from the source.
ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
  SELECT *, length(text) + CASE WHEN regexp_matches(text, '<s>|</s>|\[INST\]|\[/INST\]')
    THEN length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '[', '')) ELSE 0 END AS body,
    length(role) * 2 - length(replace(replace(replace(role, '\', ''), '<', ''), '[', '')) AS head
  FROM rows
), joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS all_text,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(24 + head + body) AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(all_text) AS turns_sha256, length(loss) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM joined
"""
