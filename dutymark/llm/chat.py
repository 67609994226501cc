"""Chat formatting with DataFrame functions only: a finite-state machine over roles, a declarative
template, text segments with a loss flag each, reversible escapes, and the way back.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dutymark.llm.common import table

BEGIN, END = "<s>", "</s>"


@dataclass(frozen=True)
class Role:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Control strings start with < or [, which are escaped in texts, so no text can hold one."""

    roles: dict[str, Role] = field(default_factory=lambda: {
        "system": Role("<<SYS>> ", " <</SYS>>"), "user": Role("[INST] ", " [/INST]"), "assistant": Role("[OUT] ", " [/OUT]", True),
    })
    #: Any other role: its escaped name stands in the mark.
    other: Role = Role("[ROLE:", " [/ROLE]")
    #: (state, role) -> state; what is missing leads to the state "invalid", which nothing leaves.
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "ready", ("start", "user"): "asked", ("ready", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked",
    })
    accept: tuple[str, ...] = ("answered",)


def escape(text: Column) -> Column:
    for raw, coded in (("\\", "\\b"), ("<", "\\l"), ("[", "\\s"), ("]", "\\e")):
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for raw, coded in (("]", "\\e"), ("[", "\\s"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(coded), F.lit(raw))
    return text


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conv_id (null is one too): segments array<struct<text,loss>>, formatted, state, valid.

    Rows are ordered by turn, then role and text; null turns come first, a null role or text counts as ''.
    A turn gives five segments: begin mark, role mark, text, end of role, end mark; only the text of a role
    with loss carries it. The machine judges the order of turns; invalid conversations are formatted as well.
    """
    t = template or Template()
    role = F.coalesce(F.col("role"), F.lit(""))
    marks = lambda get, rest: F.coalesce(*[F.when(role == n, F.lit(get(r))) for n, r in t.roles.items()], rest)
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"), role.alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("body"),
            marks(lambda r: r.open, F.concat(F.lit(t.other.open), escape(role), F.lit("] "))).alias("open"),
            marks(lambda r: r.close, F.lit(t.other.close)).alias("close"), role.isin([n for n, r in t.roles.items() if r.loss]).alias("loss"),
        ).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    part = lambda text, loss=F.lit(False): F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda x: F.array(part(F.lit(BEGIN)), part(x["open"]), part(escape(x["body"]), x["loss"]), part(x["close"]), part(F.lit(END)))))
    moves = F.create_map(*chain.from_iterable((F.lit(f"{s}|{r}"), F.lit(to)) for (s, r), to in t.moves.items()))
    state = F.aggregate("turns", F.lit("start"), lambda s, x: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit("|"), x["role"])), F.lit("invalid")))
    out = chats.select("conv_id", segments.alias("segments"), state.alias("state"))
    return out.select("conv_id", "segments", F.array_join("segments.text", "").alias("formatted"), "state", F.col("state").isin(*t.accept).alias("valid"))


def read_chats(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id and what the formatted output holds: turns array<struct<role,text>>, loss_text (unescaped texts under the mask), formatted_chars.

    Turns are read from `formatted` alone; the masked text is cut out of it at the segments' offsets.
    """
    t = template or Template()

    def turn(x: Column) -> Column:
        named = [(F.lit(n), F.lit(len(r.open)), r) for n, r in t.roles.items()]
        stop = F.locate("]", x)
        other = F.struct(
            unescape(F.substring(x, F.lit(len(t.other.open) + 1), stop - len(t.other.open) - 1)).alias("role"),
            unescape(F.substring(x, stop + 2, F.length(x) - stop - 1 - len(t.other.close))).alias("text"),
        )
        found = other
        for name, width, r in named:
            found = F.when(F.startswith(x, F.lit(r.open)), F.struct(name.alias("role"), unescape(F.substring(x, width + 1, F.length(x) - width - len(r.close))).alias("text"))).otherwise(found)
        return found

    # every turn is BEGIN .. END; both hold a raw "<", which no text does
    pieces = F.filter(F.split("formatted", f"{BEGIN}|{END}"), lambda x: x != "")
    ends = F.aggregate(
        "segments",
        F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<at:int,n:int>>").alias("spans")),
        lambda a, s: F.struct((a["at"] + F.length(s["text"])).alias("at"), F.when(s["loss"], F.concat(a["spans"], F.array(F.struct(a["at"].alias("at"), F.length(s["text"]).alias("n"))))).otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"],
    )
    spans = chats.select("conv_id", "formatted", "state", "valid", ends.alias("spans"))
    return spans.select(
        "conv_id", F.transform(pieces, turn).alias("turns"), F.length("formatted").alias("formatted_chars"), "state", "valid",
        F.array_join(F.transform("spans", lambda s: unescape(F.substring(F.col("formatted"), s["at"], s["n"]))), "").alias("loss_text"),
    )


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    back = read_chats(format_chats(own.unionByName(extra)))
    said_all = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said_all.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"), "valid",
    )


def _sql_marks() -> str:
    t = Template()
    whens = " ".join(f"when '{n}' then {len(BEGIN + END + r.open + r.close)}" for n, r in t.roles.items())
    grown = lambda x: f"len({x}) + " + " + ".join(f"len({x}) - len(replace({x}, '{c}', ''))" for c in "\\<[]")
    return f"{grown('text')} + case role {whens} else {len(BEGIN + END + t.other.open + '] ' + t.other.close)} + {grown('role')} end"


_T = Template()
OP8_SQL = f"""
with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, i, r, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) as v(i, r)),
moves as (select conv_id, turn, role, text, lag(role) over (partition by conv_id order by turn, role, text) as before, lag(role, 2) over (partition by conv_id order by turn, role, text) as before2 from turns),
chats as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as said,
  coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '') as loss, sum({_sql_marks()}) as formatted_chars,
  bool_and(case role when 'system' then before is null when 'user' then before is null or before in ('assistant', 'system') when 'assistant' then coalesce(before = 'user', false) else false end)
    and arg_max(role, (turn, role, text)) = 'assistant' as valid
  from moves group by conv_id)
select conv_id, n_turns, sha256(said) as turns_sha256, cast(len(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256, cast(formatted_chars as bigint) as formatted_chars, valid from chats
"""
