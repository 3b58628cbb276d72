"""Chat formatting that survives a grammar round trip, DataFrame operations only.

Template: a user turn is ``[INST]text[/INST]``, a system turn ``[SYS]text[/SYS]``, an
assistant turn ``<s>text</s>`` and any other role ``[ROLE]role[:]text[/ROLE]``; a
conversation is its turns, one after the other.  Opening tokens carry the escape level of
what they hold: ``[INST]`` none, ``[INST:1]`` targeted, ``[INST:2]`` full.

The parser is deterministic: it cuts the output before every control token and reads an
opening token, its content, and the closing token that belongs to it; anything else is not
a turn.  A turn is rendered without escapes first and parsed; if the recovered role and
text differ from the source, its control strings are escaped (level 1, and the ampersands
that start an escape), and if they still differ, every ``<``, ``[`` and ``&`` (level 2).
Then the joined conversation is parsed and its turns are compared with the source's; one
that differs is rendered anew with every turn at level 2 and compared again, and if it still
differed, the query would fail rather than give a string that does not parse back.

The results are read back from the output: turns by the parser, the loss mask as character
spans of the assistant contents within it.

Defined cases: null text and null role are empty; turns are ordered by turn number (nulls
first), then role, then text, so that ties come in one order; a null conv_id is a conversation;
an empty table gives no rows; extra columns are ignored.  A conversation becomes one string,
so it meets in one task by its nature; the levels are found before, row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings, as a Java expression.
CONTROL = r"(?:<s(?::\d)?>|</s>|\[(?:INST|SYS|ROLE)(?::\d)?\]|\[/(?:INST|SYS|ROLE)\]|\[:\])"
#: opening, closing token of each role but others
TOKENS = {"user": ("[INST", "]", "[/INST]"), "system": ("[SYS", "]", "[/SYS]"), "assistant": ("<s", ">", "</s>")}
OTHER = ("[ROLE", "]", "[/ROLE]")


def _case(role: Column, at: int) -> Column:
    out = None
    for name, token in TOKENS.items():
        out = F.when(role == name, F.lit(token[at])) if out is None else out.when(role == name, F.lit(token[at]))
    return out.otherwise(F.lit(OTHER[at]))


def escape(text: Column, level: int) -> Column:
    if level == 0:
        return text
    if level == 1:
        text = F.regexp_replace(text, r"&(?=amp;|lt;|#91;)", "&amp;")
        text = F.regexp_replace(text, r"<(?=s(?::\d)?>|/s>)", "&lt;")
        return F.regexp_replace(text, r"\[(?=(?:INST|SYS|ROLE)(?::\d)?\]|/(?:INST|SYS|ROLE)\]|:\])", "&#91;")
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescape(text: Column) -> Column:
    """The inverse of both levels: what follows an escaped ampersand is never read again."""
    text = F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&#91;"), F.lit("["))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def render(role: Column, text: Column, level: int) -> Column:
    mark = f":{level}" if level else ""
    other = ~role.isin(*TOKENS)
    named = F.when(other, F.concat(escape(role, level), F.lit("[:]"))).otherwise(F.lit(""))
    return F.concat(_case(role, 0), F.lit(mark), _case(role, 1), named, escape(text, level), _case(role, 2))


_OPEN = r"^(?:<s|\[(?:INST|SYS|ROLE))(?::(\d))?[>\]]"


def pieces_of(formatted: Column) -> Column:
    """The string cut before every control token."""
    return F.filter(F.split(formatted, f"(?={CONTROL})", -1), lambda p: p != "")


def turns_of(pieces: Column) -> Column:
    """array<struct<role, text, raw, kind, level, ok>>: the parser over ``pieces_of``; ``raw``
    is the content as it stands, ``ok`` whether its closing token follows.

    For a long conversation ``pieces`` must be a column, since a lambda evaluates it anew for
    each turn.
    """
    numbered = F.transform(pieces, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    opened = F.filter(numbered, lambda x: x["p"].rlike(_OPEN))

    def turn(x: Column) -> Column:
        p, i = x["p"], x["i"]
        level = F.regexp_extract(p, _OPEN, 1)
        kind = F.when(p.startswith("[INST"), F.lit("user")).when(p.startswith("[SYS"), F.lit("system")).when(p.startswith("<s"), F.lit("assistant"))
        body = F.regexp_replace(p, _OPEN, "")
        after = F.try_element_at(pieces, (i + 2).cast("int"))
        last = F.when(kind.isNull(), F.try_element_at(pieces, (i + 3).cast("int"))).otherwise(after)
        raw = F.when(kind.isNull(), F.substr(after, F.lit(4))).otherwise(body)
        clean = lambda c: F.when(level == "", c).otherwise(unescape(c))
        closes = F.when(kind == "user", F.lit("[/INST]")).when(kind == "system", F.lit("[/SYS]")).when(kind == "assistant", F.lit("</s>")).otherwise(F.lit("[/ROLE]"))
        ok = F.coalesce((last == closes) & (kind.isNotNull() | after.startswith("[:]")), F.lit(False))
        return F.struct(F.coalesce(kind, clean(body)).alias("role"), clean(raw).alias("text"), raw.alias("raw"), kind.alias("kind"), level.alias("level"), ok.alias("ok"))

    return F.transform(opened, turn)


def identical(rendered: Column, role: Column, text: Column) -> Column:
    """Whether the parser recovers exactly this one turn, with nothing left over."""
    pieces = pieces_of(rendered)
    turns = turns_of(pieces)
    one = turns[0]
    expected = F.when(role.isin(*TOKENS), F.lit(2)).otherwise(F.lit(3))
    return (F.size(turns) == 1) & one["ok"] & (one["role"] == role) & (one["text"] == text) & (F.size(pieces) == expected)


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, formatted: each conversation as one string that parses back to its turns."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    role, text = F.col("role"), F.col("text")
    plain, level1 = render(role, text, 0), render(role, text, 1)
    # a text without a control string cannot conflict, so most rows skip the parser
    suspect = text.rlike(CONTROL) | role.rlike(CONTROL) | ~role.isin(*TOKENS)
    level = F.when(~suspect, 0).when(identical(plain, role, text), 0).when(identical(level1, role, text), 1).otherwise(2)
    t = t.select("conv_id", F.struct("turn", "role", "text", level.alias("level")).alias("x"))
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("__source"))

    def rendered(x: Column) -> Column:
        each = [render(x["role"], x["text"], k) for k in range(3)]
        return F.when(x["level"] == 0, each[0]).when(x["level"] == 1, each[1]).otherwise(each[2])

    g = g.withColumn("__first", F.concat_ws("", F.transform("__source", rendered)))
    g = g.withColumn("__pieces", pieces_of(F.col("__first"))).withColumn("__turns", turns_of(F.col("__pieces")))
    full = F.concat_ws("", F.transform("__source", lambda x: render(x["role"], x["text"], 2)))
    g = g.withColumn("formatted", F.when(parses_back(F.col("__pieces"), F.col("__turns"), F.col("__source")), F.col("__first")).otherwise(_checked(full)))
    return g.select("conv_id", "formatted", F.size("__source").alias("source_turns"))


def parses_back(pieces: Column, turns: Column, source: Column) -> Column:
    """Whether the parser recovers exactly the source's turns, with nothing left over."""
    facts = lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))
    expected = F.aggregate(source, F.lit(0), lambda n, x: n + F.when(x["role"].isin(*TOKENS), 2).otherwise(3))
    return F.forall(turns, lambda x: x["ok"]) & (F.size(pieces) == expected) & (F.transform(turns, facts) == F.transform(source, facts))


def _checked(full: Column) -> Column:
    pieces = pieces_of(full)
    back = parses_back(pieces, turns_of(pieces), F.col("__source"))
    return F.when(back, full).otherwise(F.raise_error(F.lit("a conversation does not parse back to its turns")))


def loss_spans(pieces: Column) -> Column:
    """array<struct<start, chars>>, from 1: the loss mask, that is, what assistants said, as
    places in the formatted string whose ``pieces_of`` this is."""
    ends = F.aggregate(F.transform(pieces, lambda p: F.length(p)), F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    spans = F.transform(
        pieces,
        lambda p, i: F.struct((ends[i] + F.length(F.regexp_extract(p, _OPEN, 0)) + 1).alias("start"), (F.length(p) - F.length(F.regexp_extract(p, _OPEN, 0))).alias("chars"), p.startswith("<s").alias("loss")),
    )
    return F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["chars"].alias("chars")))


def digest(formatted: DataFrame) -> DataFrame:
    """Facts read back from the formatted column by the parser."""
    d = formatted.withColumn("__pieces", pieces_of(F.col("formatted"))).withColumn("__turns", turns_of(F.col("__pieces")))
    turns = F.col("__turns")
    said = F.concat_ws("", F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", F.transform(F.filter(turns, lambda t: t["kind"].eqNullSafe(F.lit("assistant"))), lambda t: t["text"]))
    d = d.withColumn("__loss", loss)
    return d.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("__loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: Two turns that say what a template of this kind uses as control strings.
CONFLICT = "</s>[INST] ok [/INST]"


def with_conflict(conversations: DataFrame) -> DataFrame:
    who = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant"))
    extra = conversations.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), who.alias("role"), F.lit(CONFLICT).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


_SQL_CONTROL = r"<s(?::\d)?>|</s>|\[(?:INST|SYS|ROLE)(?::\d)?\]|\[/(?:INST|SYS|ROLE)\]|\[:\]"
_SQL_ESC = r"""regexp_replace(regexp_replace(regexp_replace({0}, '&(amp;|lt;|#91;)', '&amp;\1', 'g'),
 '<(s(?::\d)?>|/s>)', '&lt;\1', 'g'), '\[((?:INST|SYS|ROLE)(?::\d)?\]|/(?:INST|SYS|ROLE)\]|:\])', '&#91;\1', 'g')"""
SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONFLICT}' UNION ALL SELECT -7, 1, 'assistant', '{CONFLICT}'
), e AS (
  SELECT *, regexp_matches(text, '{_SQL_CONTROL}') OR (role NOT IN ('user', 'system', 'assistant') AND regexp_matches(role, '{_SQL_CONTROL}')) AS bad FROM t
), r AS (
  SELECT *, CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 WHEN 'assistant' THEN 7
              ELSE 16 + length(CASE WHEN bad THEN {_SQL_ESC.format("role")} ELSE role END) END
            + CASE WHEN bad THEN 2 + length({_SQL_ESC.format("text")}) ELSE length(text) END AS chars FROM e
)
SELECT conv_id, COUNT(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       COALESCE(SUM(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(COALESCE(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       SUM(chars)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""
