"""Chat formatting by a declarative template, in DataFrame operations only.

A finite-state machine over the roles validates the order of turns; every turn becomes three segments (opening mark,
text, closing mark) with a loss flag each. Texts are escaped so that none of the template's control
strings is left in them, and `turns_of` and `loss_text` read everything back from the segments.
"""

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """opening and closing mark of a turn ({role} stands for the escaped role), roles under the loss, control strings to
    escape in texts, and the state machine: for each role (or "" at the start) the roles that may follow."""

    opening: str = "<|{role}|>\n"
    closing: str = "</s>\n"
    loss_roles: tuple = ("assistant",)
    controls: tuple = ("<|", "|>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    follows: dict = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    last: tuple = ("assistant",)

    @property
    def marks(self):
        return "".join(re.escape(c) for c in sorted({c[0] for c in self.controls}))

    def escape(self, text: Column) -> Column:
        """A backslash after every backslash, after the first character of every control string, and after such a character before a backslash."""
        rest = {}
        for c in self.controls:
            rest.setdefault(c[0], []).append(re.escape(c[1:]))
        starts = "|".join(f"{re.escape(c)}(?={'|'.join(r)}|\\\\)" for c, r in rest.items())
        return F.regexp_replace(text, f"(\\\\|{starts})", r"$1\\")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, f"([{self.marks}\\\\])\\\\", "$1")


def _text(name):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def format_chats(turns: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_col, segments array<struct<text, loss>>, formatted, valid, state), one row for each conversation.

    Turns go by turn number (null first), then role and text; repeated rows are turns of their own. A null text or role is
    empty; a null conversation id is a conversation. valid: the machine accepts the order of roles; `state` is
    where it ended ("error" after a turn that may not follow). Conversations that are not valid are formatted all the
    same. An empty table gives an empty result; other columns are not looked at. A conversation is one text, so
    its turns meet in one task.
    """
    rows = turns.select(F.col(conv_col).alias("conv"), F.struct(F.col(turn_col).alias("turn"), _text(role_col).alias("role"), _text(text_col).alias("text")).alias("t"))
    convs = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    allowed = {f"{a}>{b}": b for a, after in template.follows.items() for b in after}
    moves = F.create_map(*(F.lit(x) for pair in allowed.items() for x in pair))
    state = F.aggregate("turns", F.lit(""), lambda s, t: F.coalesce(F.element_at(moves, F.concat(s, F.lit(">"), t.role)), F.lit("error")))
    before, after = template.opening.split("{role}")

    def pieces(t):
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(part(F.concat(F.lit(before), template.escape(t.role), F.lit(after)), F.lit(False)), part(template.escape(t.text), t.role.isin(*template.loss_roles)), part(F.lit(template.closing), F.lit(False)))

    out = convs.select("conv", F.flatten(F.transform("turns", pieces)).alias("segments"), state.alias("state"), F.size("turns").alias("_n"))
    return out.select(F.col("conv").alias(conv_col), "segments", F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"), F.col("state").isin(*template.last).alias("valid"), "state")


def turns_of(formatted: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    before, after = (re.escape(x) for x in template.opening.split("{role}"))
    parts = F.split(formatted, re.escape(template.closing), -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    whole = f"(?s)^{before}(.*?){after}(.*)$"
    return F.transform(parts, lambda p: F.struct(template.unescape(F.regexp_extract(p, whole, 1)).alias("role"), template.unescape(F.regexp_extract(p, whole, 2)).alias("text")))


def loss_text(segments: Column, template: Template = Template()) -> Column:
    """The unescaped text under the loss mask, end to end."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: template.unescape(s.text)), "")


def digest(chats: DataFrame, template: Template = Template(), conv_col: str = "conv_id") -> DataFrame:
    """(conv_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid), all but the last read back from the output."""
    rows = chats.select(conv_col, turns_of(F.col("formatted"), template).alias("turns"), loss_text(F.col("segments"), template).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return rows.select(conv_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "valid")
