"""Chat formatting with DataFrame functions alone: a finite-state machine over roles, and segments with loss flags.

The template is data: markers, the roles whose text is trained on, and the machine's transitions. Control
strings inside a text are escaped so that markers stand only where the template put them, and come back whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    trained: tuple[str, ...] = ("assistant",)
    begin: str = "begin"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("begin", "system"): "system",
            ("begin", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    accept: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escaped(text: Column) -> Column:
    r"""Double every backslash, then part '<' from '|' by one: '<\|' can only come from here."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    r"""A role stands on the marker's line, so its line feeds are written '<\n>', which escaping leaves free."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("<\\n>"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("<\\n>"), F.lit("\n")))


def _machine(turns: Column, template: Template) -> Column:
    """The state after the last turn; null from the first turn that no transition allows."""

    def step(state: Column, turn: Column) -> Column:
        out = F.lit(None).cast("string")
        for (before, role), after in template.moves.items():
            out = F.when((state == before) & (turn["role"] == role), F.lit(after)).otherwise(out)
        return out

    return F.aggregate(turns, F.lit(template.begin).cast("string"), step)


def _segments(turns: Column, template: Template) -> Column:
    def of(turn: Column) -> Column:
        fixed = lambda text: F.struct(text.alias("text"), F.lit(False).alias("loss"))
        return F.array(
            fixed(F.concat(F.lit(template.start), escaped_role(turn["role"]), F.lit("\n"))),
            F.struct(escaped(turn["text"]).alias("text"), turn["role"].isin(*template.trained).alias("loss")),
            fixed(F.lit(template.end)),
        )

    return F.flatten(F.transform(turns, of))


def format_conversations(conversations: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per conversation: conv_id, valid, segments (text, loss) and formatted, the segments' texts joined.

    Rows are taken by turn (a null turn first; equal turns by role, then text, so that repeated rows both stay).
    A null role or text is empty. `valid` says whether the template's machine accepts the order of roles; an
    invalid conversation is formatted all the same, for the caller to judge. Rows without conv_id form one
    conversation. A conversation is one string in the output, so its rows meet in one task by necessity;
    nothing else does. Other columns are ignored.
    """
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    turns = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text")))).alias("turns")
    )
    segments = turns.select("conv_id", F.coalesce(_machine(F.col("turns"), template).isin(*template.accept), F.lit(False)).alias("valid"), _segments(F.col("turns"), template).alias("segments"))
    return segments.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column, template: Template = CHATML) -> Column:
    """The (role, text) turns that a formatted string holds."""
    parts = F.filter(F.split(formatted, r"\Q" + template.end + r"\E"), lambda p: p != "")

    def of(part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        return F.struct(
            unescaped_role(F.substring(head, F.lit(len(template.start) + 1), F.length(head))).alias("role"),
            unescaped(F.substring(part, F.length(head) + 2, F.length(part))).alias("text"),
        )

    return F.transform(parts, of)


def chat_digests(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """Digests of formatted conversations, read back from the output: the turns from `formatted`, the trained text from `segments`."""
    read = formatted.select(
        "conv_id", "valid", F.length("formatted").cast("long").alias("formatted_chars"), read_turns(F.col("formatted"), template).alias("turns"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "").alias("trained"),
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )
