"""Chat formatting: a finite-state machine over roles and a declarative template; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table


@dataclass(frozen=True)
class Template:
    """How turns are written, and which orders of turns are valid.

    open, close: the marks around a turn; between open and the text stands the role and a line feed.
    controls: further strings that no text may smuggle in. Marks and controls start with a character that stands nowhere
    else in them and isn't a backslash, so that no text and mark together make another control string.
    trained: roles whose text is under the loss mask.
    start: the state before the first turn; after it, the state is the last role.
    moves: (state, role) pairs that are allowed; ends: the states in which a conversation may end.
    """

    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
    trained: tuple[str, ...] = ("assistant",)
    start: str = "^"
    moves: frozenset[tuple[str, str]] = field(
        default_factory=lambda: frozenset(
            {("^", "system"), ("^", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}
        )
    )
    ends: tuple[str, ...] = ("assistant",)

    def all_controls(self) -> list[str]:
        return list(dict.fromkeys([self.open, self.close.rstrip("\n"), *self.controls]))


CHATML = Template()


def _quote(text: str) -> str:
    return "".join(c if c.isalnum() else f"\\{c}" for c in text)


def escape(text: Column, template: Template = CHATML) -> Column:
    """Doubles backslashes and puts one after the first character of each control string; unescape() is its inverse."""
    heads = {}
    for control in template.all_controls():
        heads.setdefault(control[0], []).append(_quote(control[1:]))
    pattern = "|".join(f"(?<={_quote(head)})(?={'|'.join(tails)})" for head, tails in heads.items())
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), pattern, r"\\")


def escape_role(role: Column, template: Template = CHATML) -> Column:
    return F.regexp_replace(escape(role, template), "\n", "\\\\\n")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chat(conversations: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per conv_id: conv_id, n_turns long, valid boolean, state string, segments array<struct<text, loss>>.

    The concatenated segment texts are the formatted conversation. Turns stand in order of turn, ties in order of role
    and text; repeated rows are turns of their own. A null role or text counts as empty, a null turn comes first, rows
    whose conv_id is null make one conversation. valid says whether the machine accepts the order of the roles; invalid
    conversations are formatted too, for the caller to drop. Other columns play no part. A conversation becomes one row,
    which is what is asked for, so the longest one must fit a task.
    """
    moves = F.array(*[F.lit(f"{state}\n{role}") for state, role in sorted(template.moves)])
    state = F.aggregate(
        "turns",
        F.lit(template.start),
        lambda state, turn: F.when(
            state.isNotNull() & F.array_contains(moves, F.concat(state, F.lit("\n"), turn["role"])), turn["role"]
        ),
    )

    def segments(turn: Column) -> Column:
        def segment(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        mark = F.concat(F.lit(template.open), escape_role(turn["role"], template), F.lit("\n"))
        return F.array(
            segment(mark, F.lit(False)),
            segment(escape(turn["text"], template), turn["role"].isin(*template.trained)),
            segment(F.lit(template.close), F.lit(False)),
        )

    empty = F.lit("")
    turns = conversations.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
            )
        ).alias("turns")
    )
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.coalesce(state.isin(*template.ends), F.lit(False)).alias("valid"),
        state.alias("state"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
    )


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_back(text: Column, template: Template = CHATML) -> Column:
    """array<struct<role, text>>, unescaped, from a formatted conversation."""
    parts = F.filter(F.split(text, _quote(template.close)), lambda p: F.startswith(p, F.lit(template.open)))
    head = "(?s)^" + _quote(template.open) + r"((?:[^\\\n]|\\.)*+)\n"
    return F.transform(
        parts,
        lambda part: F.struct(
            unescape(F.regexp_extract(part, head, 1)).alias("role"),
            unescape(F.regexp_replace(part, head, "")).alias("text"),
        ),
    )


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    extra = spark.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(probe).alias("text")) for i, r in enumerate(("user", "assistant"))]))
    )
    out = format_chat(rows.unionByName(extra)).withColumn("text", formatted(F.col("segments")))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.withColumn("turns", read_back(F.col("text"))).withColumn("loss", loss_text(F.col("segments"))).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("text").cast("long").alias("formatted_chars"),
        "valid",
    )


def op7_sql() -> str:
    def escaped(expr: str) -> str:
        expr = f"replace({expr}, '\\', '\\\\')"
        for c in CHATML.all_controls():
            expr = f"replace({expr}, '{c}', '{c[0]}\\{c[1:]}')"
        return expr

    moves = ", ".join(f"'{a} {b}'" for a, b in sorted(CHATML.moves))
    fixed = len(CHATML.open) + 1 + len(CHATML.close)
    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
moved AS (
  SELECT *, coalesce(lag(role) OVER w, '^') || ' ' || role IN ({moves}) AS ok,
         row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({fixed} + length(replace({escaped('role')}, chr(10), '\\' || chr(10))) + length({escaped('text')}))::BIGINT AS formatted_chars,
  bool_and(ok) AND bool_or(k = n AND role = 'assistant') AS valid
FROM moved GROUP BY conv_id"""
