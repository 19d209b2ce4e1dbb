"""Chat formatting in DataFrame operations: a template, a finite-state machine over roles, text segments with loss flags."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Strings that common chat templates use as control tokens.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


@dataclass(frozen=True)
class Template:
    """A turn is open + role + newline + text + close. `loss` names the roles whose text is learned.

    moves: (state, role) -> state of the turn-order machine; the state after a turn is its role, what is missing is refused.
    """

    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    control: tuple[str, ...] = CONTROL
    loss: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    accept: frozenset[str] = frozenset({"assistant"})
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"})


def _quote(s: str) -> str:
    return "".join("\\" + c if c in r"\[](){}|.*+?^$" else c for c in s)


def _control_pattern(t: Template, slashes: str) -> str:
    heads = "".join(sorted({c[0] for c in t.control}))
    tails = "|".join(_quote(c[1:]) for c in sorted(t.control, key=len, reverse=True))
    return f"([{_quote(heads)}]){slashes}({tails})"


def escape(text: Column, t: Template) -> Column:
    """A backslash goes behind the first character of each control string; those that have some get one more."""
    return F.regexp_replace(text, _control_pattern(t, r"(\\*)"), r"$1\\$2$3")


def unescape(text: Column, t: Template) -> Column:
    return F.regexp_replace(text, _control_pattern(t, r"\\(\\*)"), r"$1$2$3")


def _moves(t: Template) -> Column:
    return F.create_map(*[F.lit(x) for (state, role), to in t.moves.items() for x in (f"{state} {role}", to)])


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, formatted, segments array<struct<start,length,role,loss>>, valid, n_turns for rows (conv_id, turn, role, text).

    Turns are ordered by turn, ties by role and text; repeated rows are turns of their own. A null text is empty, a null role
    is the empty role (which no move allows), null conv_ids are one conversation. `valid` says whether the machine accepts
    the roles; refused conversations are formatted too. Segments are the texts' places in `formatted`, in code points.
    """
    t = template or Template()
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    row = F.struct("turn", role.alias("role"), text.alias("raw"), F.concat(F.lit(t.open), F.url_encode(role), F.lit("\n")).alias("head"), escape(text, t).alias("body"))
    chats = turns.select("conv_id", row.alias("r")).groupBy("conv_id").agg(F.sort_array(F.collect_list("r")).alias("rows"))
    close, n = F.lit(t.close), F.char_length
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long,role:string,loss:boolean>>").alias("done"))

    def place(state: Column, r: Column) -> Column:
        head, body = n(r["head"]).cast("long"), n(r["body"]).cast("long")
        segment = F.struct((state["at"] + head).alias("start"), body.alias("length"), r["role"].alias("role"), r["role"].isin(*t.loss).alias("loss"))
        return F.struct((state["at"] + head + body + len(t.close)).alias("at"), F.concat(state["done"], F.array(segment)).alias("done"))

    state = F.aggregate("rows", F.lit(t.start), lambda s, r: F.coalesce(F.element_at(_moves(t), F.concat_ws(" ", s, r["role"])), F.lit("refused")))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("rows", lambda r: F.concat(r["head"], r["body"], close)), "").alias("formatted"),
        F.aggregate("rows", start, place, lambda s: s["done"]).alias("segments"),
        state.isin(*t.accept).alias("valid"),
        F.size("rows").cast("long").alias("n_turns"),
    )


def read_back(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, turns array<struct<role,text>> parsed from `formatted`, loss_texts array<string> cut out by the loss flags."""
    t = template or Template()
    pieces = F.filter(F.split("formatted", _quote(t.close)), lambda x: x != "")
    head = len(t.open)

    def turn(x: Column) -> Column:
        at = F.instr(x, "\n")
        return F.struct(F.url_decode(F.substr(x, F.lit(head + 1), at - head - 1)).alias("role"), unescape(F.substr(x, at + 1), t).alias("text"))

    cut = lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")), t)
    return chats.withColumns({"turns": F.transform(pieces, turn), "loss_texts": F.transform(F.filter("segments", lambda s: s["loss"]), cut)})
