"""Chat formatting by grammar round trip, in DataFrame operations only.

Turns are rendered with one pair of marks for each role. The rendered text is
then parsed again by a deterministic parser and the turns it finds are
compared with the source; where they differ, the conflicting content is
escaped and the conversation rendered anew, until both are identical:

0. texts as they are;
1. escaped where a text holds the first character of any mark;
2. every text and role escaped.

The escape ``~`` maps ``~ [ <`` to ``~0 ~1 ~2``, so an escaped text holds no
character that begins a mark, and level 2 always reads back. A mark says
whether its text is escaped: ``[INST~] `` and so on.

    system      <<SYS>>text<</SYS>>
    user        [INST] text [/INST]
    assistant   <s>text</s>
    any other   <role=name>text</role>      the name always escaped

Null texts and roles count as empty; a null turn number sorts first; rows of
the same turn are ordered by role and text; repeated rows are turns of their
own. A conversation is one row of the result, as its digest needs it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed marks: role, opening, opening of an escaped text, closing.
MARKS = (
    ("system", "<<SYS>>", "<<SYS~>>", "<</SYS>>"),
    ("user", "[INST] ", "[INST~] ", " [/INST]"),
    ("assistant", "<s>", "<s~>", "</s>"),
)
OTHER = ("<role=", "<role~=", ">", "</role>")
_OPENINGS = [m for _, a, b, _ in MARKS for m in (a, b)] + list(OTHER[:2])
#: Divides a rendered conversation in front of each opening mark.
TURN = "(?=" + "|".join("\\Q" + m + "\\E" for m in _OPENINGS) + ")"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("["), F.lit("~1")), F.lit("<"), F.lit("~2"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("~1"), F.lit("[")), F.lit("~2"), F.lit("<")), F.lit("~0"), F.lit("~"))


def rendered(turns: Column, level: int) -> Column:
    """The text of an array of struct(role, text)."""

    def turn(t: Column) -> Column:
        body = t["text"]
        conflict = F.lit(level == 2) if level != 1 else body.contains("[") | body.contains("<") | body.contains("~")
        text = F.when(conflict, escaped(body)).otherwise(body)
        name = F.replace(escaped(t["role"]), F.lit(">"), F.lit("~3"))
        out = F.concat(F.when(conflict, F.lit(OTHER[1])).otherwise(F.lit(OTHER[0])), name, F.lit(OTHER[2]), text, F.lit(OTHER[3]))
        for role, plain, marked, close in MARKS[::-1]:
            out = F.when(t["role"] == role, F.concat(F.when(conflict, F.lit(marked)).otherwise(F.lit(plain)), text, F.lit(close))).otherwise(out)
        return out

    return F.array_join(F.transform(turns, turn), "")


def parsed(formatted: Column) -> Column:
    """The turns, as struct(role, text), that the grammar finds in a rendered text."""

    def between(piece: Column, open_length, close: str) -> Column:
        return F.substring(piece, open_length + 1, F.length(piece) - open_length - len(close))

    def turn(piece: Column) -> Column:
        stop = F.instr(piece, OTHER[2])
        out = F.struct(F.lit(None).cast("string").alias("role"), piece.alias("text"))
        for mark, coded in ((OTHER[0], False), (OTHER[1], True)):
            name = F.substring(piece, F.lit(len(mark) + 1), stop - len(mark) - 1)
            body = between(piece, stop, OTHER[3])
            role = unescaped(F.replace(name, F.lit("~3"), F.lit(">")))
            fits = piece.startswith(mark) & piece.endswith(OTHER[3])
            out = F.when(fits, F.struct(role.alias("role"), (unescaped(body) if coded else body).alias("text"))).otherwise(out)
        for role, plain, marked, close in MARKS[::-1]:
            for mark, coded in ((plain, False), (marked, True)):
                body = between(piece, F.lit(len(mark)), close)
                fits = piece.startswith(mark) & piece.endswith(close)
                out = F.when(fits, F.struct(F.lit(role).alias("role"), (unescaped(body) if coded else body).alias("text"))).otherwise(out)
        return out

    return F.transform(F.filter(F.split(formatted, TURN), lambda p: p != ""), turn)


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): the rows of each conversation in order of turn."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def formatted(rows: DataFrame) -> DataFrame:
    """(conv_id, turns, formatted, level, parsed) with parsed = turns, the first level that reads back."""
    out = conversations(rows).withColumn("_0", rendered(F.col("turns"), 0))
    out = out.withColumn("_same0", parsed(F.col("_0")).eqNullSafe(F.col("turns")))
    out = out.withColumn("_1", F.when(~F.col("_same0"), rendered(F.col("turns"), 1)))
    out = out.withColumn("_same1", F.coalesce(parsed(F.col("_1")).eqNullSafe(F.col("turns")), F.lit(False)))
    out = out.withColumn("level", F.when(F.col("_same0"), 0).when(F.col("_same1"), 1).otherwise(2))
    text = F.when(F.col("level") == 0, F.col("_0")).when(F.col("level") == 1, F.col("_1")).otherwise(rendered(F.col("turns"), 2))
    out = out.withColumn("formatted", text)
    return out.select("conv_id", "turns", "formatted", "level", parsed(F.col("formatted")).alias("parsed"))


def digests(chats: DataFrame) -> DataFrame:
    """What is read back from the formatted text: turns and the text under the loss mask."""
    every = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("parsed", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return chats.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(every.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
