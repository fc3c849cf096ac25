"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is written ``<|im_start|>role NEWLINE text <|im_end|> NEWLINE``. Every turn is first written as it is and read
back by the parser; where what comes back is not the very source, control-like strings in its text are escaped: each
``<`` + backslashes + ``|`` gets one backslash more, and the reader takes one away. Escaped text holds no ``<|``, so one
round is enough, and text that needs no escape keeps its form. Roles are percent-encoded where they hold a line feed,
``|`` or ``%``.

The output of a conversation is its list of segments, each with its loss flag; joined, they are the formatted text.
Only texts of the role ``assistant`` are under the loss mask.

Defined cases: null role and null text are empty; turns are ordered by (turn, role, text), null turns first, and
repeated rows are repeated turns; rows with a null conversation id form one conversation; an empty table gives an empty
result; other columns are not looked at. One conversation is one value, so a single conversation must fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, LOSS_ROLE = "<|im_start|>", "<|im_end|>", "assistant"
#: One turn: role, body. A body holds neither START nor END.
TURN = r"(?s)<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("|"), F.lit("%7C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%7C"), F.lit("|")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), body, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """Array of (role, text), as the source had them; null where something isn't a turn."""
    roles, bodies = (F.regexp_extract_all(formatted, F.lit(TURN), F.lit(i)) for i in (1, 2))
    turns = F.transform(
        F.arrays_zip(roles.alias("role"), bodies.alias("text")),
        lambda t: F.struct(unescape_role(t["role"]).alias("role"), unescape_text(t["text"]).alias("text")),
    )
    left = F.regexp_replace(formatted, TURN, "")
    stray = F.exists(bodies, lambda b: F.contains(b, F.lit(START)) | F.contains(b, F.lit(END)))
    return F.when((left == "") & ~stray, turns)


def format_conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, formatted, segments array<struct<text, loss>>): one row per conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    source = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    source = source.withColumn("name", escape_role(F.col("role")))
    back = parse(render(F.col("name"), F.col("text")))
    same = back == F.array(F.struct("role", "text"))
    body = F.when(F.coalesce(same, F.lit(False)), F.col("text")).otherwise(escape_text(F.col("text")))
    turns = source.select("conv_id", F.struct("turn", "role", "text", "name", body.alias("body")).alias("t"))
    per = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    flag = F.lit(False)
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(F.concat(F.lit(START), t["name"], F.lit("\n")).alias("text"), flag.alias("loss")),
                F.struct(t["body"].alias("text"), (t["role"] == LOSS_ROLE).alias("loss")),
                F.struct(F.lit(END + "\n").alias("text"), flag.alias("loss")),
            ),
        )
    )
    out = per.select("conv_id", segments.alias("segments"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: DataFrame) -> DataFrame:
    """What the output says: turns by parsing its text, loss text by its mask."""
    turns = F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape_text(s["text"]))
    return (
        formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("parsed"), F.array_join(loss, "").alias("loss"))
        .select(
            "conv_id",
            F.size("parsed").cast("long").alias("n_turns"),
            F.sha2(F.array_join(turns, "").cast("binary"), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )
