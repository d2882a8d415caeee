"""Operator 3 [native]: chat formatting by a finite-state machine over roles and a declarative template.

Only DataFrame functions run here. A conversation's turns are put in order (turn, role, text), a fold over
their roles walks the machine's transition table, and the template turns each turn into text segments, of
which those of the loss roles' texts carry the loss flag. The template is data: what opens a turn of each role,
what closes it, which roles bear loss, which turns may follow. Escapes are derived from it: each of its control
strings has a mark, a character of it that no escaped text holds, since texts show a mark as a backslash and
a letter, and a backslash as two characters as well. So no text can close a turn or open one, whatever
it says. read_back() splits the formatted text at the control strings and undoes the escapes. A template whose
control strings could be taken for each other is refused.

The rows of a conversation meet in one row, since its formatted text is one value; partial lists are
built before the shuffle.

Defined results: a null text is empty, a null role is the role ''; roles without a header of their own
get the general one; equal turns keep their order by role and text, repeated rows are turns of their
own; conversations that the machine refuses are formatted and marked valid = false; rows without a
conv_id form one conversation; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What an escape begins with, and what follows it: for the backslash itself, then for each mark.
ESCAPE, CODES = "\\", "0abcdefghijklmnopqrstuvwxyz"


def _mark(control: str) -> str:
    """The character by which texts are kept from holding a control string: its first that is no letter, digit or space, or else its first."""
    return next((c for c in control if not c.isalnum() and not c.isspace()), control[0])


@dataclass(frozen=True)
class Template:
    """headers: role to what opens its turn. general: what opens a turn of another role, before and after its name."""

    headers: dict[str, str] = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    general: tuple[str, str] = ("### Role ", " ### ")
    close: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: (state, role) to state; anything else leads to the error state.
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {("start", "system"): "primed", ("start", "user"): "asked", ("primed", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"}
    )
    final: tuple[str, ...] = ("answered",)

    def __post_init__(self):
        opening = [*self.headers.values(), self.general[0]]
        if not all([*opening, self.general[1], self.close]):
            raise ValueError("control strings must not be empty")
        if any(a != b and b.startswith(a) or a == b and i != j for i, a in enumerate(opening) for j, b in enumerate(opening)):
            raise ValueError("no header may begin with another")
        for end, before in ((self.close, [*opening, self.general[1]]), (self.general[1], [self.general[0]])):
            if any(_mark(end) in tail and (end.startswith(tail) or end in tail) for text in before for tail in (text[p:] for p in range(len(text)))):
                raise ValueError(f"{end!r} may not begin inside another control string")
        if set(self.marks) & {ESCAPE, *CODES}:
            raise ValueError("a control string needs a character that is no lower-case letter, no 0 and no backslash")
        if len(self.marks) >= len(CODES):
            raise ValueError("too many control strings")

    @property
    def marks(self) -> tuple[str, ...]:
        return tuple(sorted({_mark(c) for c in (*self.headers.values(), *self.general, self.close)}))

    @property
    def escapes(self) -> list[tuple[str, str]]:
        """(character, what stands for it), the backslash first."""
        return [(c, ESCAPE + code) for c, code in zip((ESCAPE, *self.marks), CODES, strict=False)]


def escape(text: Column, template: Template | None = None) -> Column:
    """The text with no mark left in it."""
    for character, said in (template or Template()).escapes:
        text = F.replace(text, F.lit(character), F.lit(said))
    return text


def unescape(text: Column, template: Template | None = None) -> Column:
    """Undoes escape(): every backslash begins an escape, so the order is that of escape() backwards."""
    for character, said in reversed((template or Template()).escapes):
        text = F.replace(text, F.lit(said), F.lit(character))
    return text


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, n_turns, valid, state, segments array<struct<text, loss>>, formatted, loss array<boolean> of each conversation of (conv_id, turn, role, text).

    loss says of each turn of the formatted text whether its text is under the loss mask.
    """
    t = template or Template()
    clean = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    table = F.create_map(*(F.lit(x) for (state, role), to in t.transitions.items() for x in (f"{state}\n{role}", to)))
    state = F.aggregate("turns", F.lit(t.start), lambda s, x: F.coalesce(F.element_at(table, F.concat(s, F.lit("\n"), x["role"])), F.lit("error")))
    headers = F.create_map(*(F.lit(x) for pair in t.headers.items() for x in pair))

    def segments(x: Column) -> Column:
        own = F.concat(F.lit(t.general[0]), escape(x["role"], t), F.lit(t.general[1]))
        head = F.coalesce(F.element_at(headers, x["role"]), own)
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(x["text"], t).alias("text"), x["role"].isin(*t.loss_roles).alias("loss")),
            F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")),
        )

    out = grouped.withColumn("state", state).withColumn("segments", F.flatten(F.transform("turns", segments)))
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    loss = F.transform("turns", lambda x: x["role"].isin(*t.loss_roles))
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.col("state").isin(*t.final).alias("valid"), "state", "segments", formatted.alias("formatted"), loss.alias("loss"))


def _literally(text: str) -> str:
    """A pattern of a text itself."""
    return "".join(c if c.isalnum() else f"\\{c}" for c in text)


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    t = template or Template()
    pieces = F.split(formatted, _literally(t.close))
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        rest = F.substring(piece, F.lit(len(t.general[0]) + 1), F.length(piece))
        cut = F.instr(rest, t.general[1])
        role = unescape(F.substring(rest, F.lit(1), cut - 1), t)
        text = F.substring(rest, cut + len(t.general[1]), F.length(rest))
        for name, head in t.headers.items():
            mine = F.startswith(piece, F.lit(head))
            role = F.when(mine, F.lit(name)).otherwise(role)
            text = F.when(mine, F.substring(piece, F.lit(len(head) + 1), F.length(piece))).otherwise(text)
        return F.struct(role.alias("role"), unescape(text, t).alias("text"))

    return F.transform(pieces, turn)


def digest_conversations(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """What the query returns, read back from the formatted text, of which the mask tells the turns that bear loss."""
    read = formatted.select("conv_id", "valid", "loss", read_back(F.col("formatted"), template).alias("turns"), F.length("formatted").cast("long").alias("formatted_chars"))
    whole = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    masked = F.zip_with("turns", "loss", lambda x, bears: F.when(bears, x["text"]).otherwise(""))
    rows = read.select("conv_id", "valid", "formatted_chars", whole.alias("turns"), F.array_join(masked, "").alias("loss"))
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )


PROBE = "\\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return digest_conversations(format_conversations(turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(probe)))


ORACLE = r"""
WITH turns AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 ELSE 14 + length(replace(replace(replace(role, '\', '..'), '#', '..'), '<', '..')) END
    + length(replace(replace(replace(text, '\', '..'), '#', '..'), '<', '..')) + 8 AS chars,
    CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS letter
  FROM turns
), joined AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(chars) AS chars, string_agg(letter, '' ORDER BY turn, role, text) AS letters
  FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(chars AS BIGINT) AS formatted_chars, regexp_full_match(letters, 's?(ua)+') AS valid
FROM joined
"""
