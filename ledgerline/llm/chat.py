"""Chat formatting: a finite-state machine over roles and a declarative template.

The rows of a conversation, by turn, run through the machine of ``MOVES``; ``valid`` says whether every
turn was allowed, ``complete`` whether the last one was an assistant's.  Every turn gives three segments
(opening, text, closing) by the template, and only texts of roles marked for loss have the loss flag.
Invalid conversations are formatted too; drop them by the flag.

Reversible: in texts and role names every control string of the template gets a backslash after its first
character, on top of those already there; reading takes one away.  So no text can close or open a turn.

Defined cases: a null text is empty; a null role is the empty role; roles without a template line are written
with the open form and are not valid; rows are ordered by turn (null first), then role and text, so ties and
repeated rows have a fixed order and all count; rows with a null conversation id are one conversation; an
empty table gives no rows.  Only the four named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: role: (opening, closing, loss on the text)
TEMPLATE = {
    "system": ("<s>[SYS] ", " [/SYS]", False),
    "user": ("<s>[INST] ", " [/INST]", False),
    "assistant": ("<s>[OUT] ", " </s>", True),
}
#: any other role: its name goes between the first two
OTHER = ("<s>[ROLE] ", " [/ROLE] ", " [/END]")

MOVES = {"start": {"system": "system", "user": "user"}, "system": {"user": "user"},
         "user": {"assistant": "assistant"}, "assistant": {"user": "user"}}

CONTROL = r"/?(?:s>|(?:SYS|INST|OUT|ROLE|END)\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", "$1$2$3")


def _segments(turn: Column) -> Column:
    """The segments of one turn, struct(text, loss) each."""
    seg = lambda text, loss: F.struct(text.alias("text"), F.lit(loss).alias("loss"))
    text = escape(turn["text"])
    out = F.array(seg(F.concat(F.lit(OTHER[0]), escape(turn["role"]), F.lit(OTHER[1])), False), seg(text, False),
                  seg(F.lit(OTHER[2]), False))
    for role, (opening, closing, loss) in TEMPLATE.items():
        out = F.when(turn["role"] == role, F.array(seg(F.lit(opening), False), seg(text, loss), seg(F.lit(closing), False))).otherwise(out)
    return out


def _final_state(roles: Column) -> Column:
    def move(state, role):
        out = F.lit("error")
        for s, moves in MOVES.items():
            for r, to in moves.items():
                out = F.when((state == s) & (role == r), F.lit(to)).otherwise(out)
        return out
    return F.aggregate(roles, F.lit("start"), move)


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id``, ``valid``, ``complete``, ``segments`` (array of text and loss
    flag) and ``formatted`` (the segments in a row).  Texts are escaped before the rows are grouped."""
    turn = F.struct(F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = df.select(F.col(f"`{conv_col}`").alias("conv_id"), turn.alias("t"))
    rows = rows.select("conv_id", F.struct("t.turn", "t.role", "t.text", _segments(F.col("t")).alias("segments")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    state = _final_state(F.col("turns.role"))
    segments = F.flatten(F.col("turns.segments"))
    out = chats.select("conv_id", state.alias("state"), segments.alias("segments"))
    return out.select("conv_id", (F.col("state") != "error").alias("valid"), (F.col("state") == "assistant").alias("complete"),
                      "segments", F.array_join("segments.text", "").alias("formatted"))


def read_chats(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of struct(role, text), unescaped."""
    def turn(part):
        def between(opening, closing):
            start = len(opening) - len("<s>") + 1
            return F.substring(part, F.lit(start), F.length(part) - F.lit(start - 1 + len(closing)))
        inner = between(OTHER[0], OTHER[2])
        cut = F.locate(OTHER[1], inner)
        out = F.struct(unescape(F.substring(inner, F.lit(1), cut - 1)).alias("role"),
                       unescape(F.substring(inner, cut + len(OTHER[1]), F.length(inner))).alias("text"))
        for role, (opening, closing, _) in TEMPLATE.items():
            out = F.when(part.startswith(opening.removeprefix("<s>")),
                         F.struct(F.lit(role).alias("role"), unescape(between(opening, closing)).alias("text"))).otherwise(out)
        return out
    parts = F.split(formatted, "<s>", -1)
    return F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped segment by segment."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
