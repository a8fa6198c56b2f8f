"""Chat formatting by schema fingerprint. DataFrame functions only.

The nested field paths of a record are hashed; the hash selects a declarative mapping that turns
its layout (prompt and response, instruction with input, message lists, one row per turn) into
canonical turns (role, text). Turns are rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``.
``%`` and ``<|`` inside texts (and ``<``, newline inside roles) are percent-escaped, so the
template's control strings never occur in a text and reading back is exact.

Defined cases: null role or text counts as empty; turns are ordered by turn, role, text, null
first; repeated turns are kept; rows without a conversation id are one conversation; a conversation is
one string, and so one row of one task, however long it is; records with an unknown fingerprint or invalid JSON come back
from ``unmatched`` and never crash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape_text(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("%"), F.lit("%25")), F.lit("<|"), F.lit("%3C|"))


def escape_role(role: Column) -> Column:
    out = F.coalesce(role, F.lit(""))
    for raw, coded in (("%", "%25"), ("<", "%3C"), ("\n", "%0A")):
        out = F.replace(out, F.lit(raw), F.lit(coded))
    return out


def unescape(value: Column) -> Column:
    for raw, coded in (("\n", "%0A"), ("<", "%3C"), ("%", "%25")):
        value = F.replace(value, F.lit(coded), F.lit(raw))
    return value


@dataclass(frozen=True)
class Mapping:
    """A layout: the variant type of its records, and the turns it holds as array<struct<role, text>>."""

    name: str
    shape: str
    turns: Callable[[Column], Column]

    @property
    def fingerprint(self) -> str:
        return hashlib.md5(self.shape.encode()).hexdigest()


def _field(path: str) -> Callable[[Column], Column]:
    return lambda v: F.try_variant_get(v, path, "string")


def _said(*parts: tuple[str, Callable[[Column], Column]]) -> Callable[[Column], Column]:
    """Fixed roles, each with the text of a field."""
    return lambda v: F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(get(v), F.lit("")).alias("text")) for role, get in parts])


def _listed(path: str, role: str, text: str, names: dict[str, str] | None = None) -> Callable[[Column], Column]:
    """A list of messages; ``names`` renames roles."""

    def turns(v: Column) -> Column:
        items = F.try_variant_get(v, path, f"array<struct<`{role}`: string, `{text}`: string>>")
        role_name = lambda x: F.coalesce(*[F.when(x == old, F.lit(new)) for old, new in (names or {}).items()], x)
        said = F.transform(items, lambda x: F.struct(role_name(x[role]).alias("role"), x[text].alias("text")))
        return said

    return turns


#: Layouts that are known from the start; more may be passed to the functions below.
MAPPINGS = (
    Mapping("prompt_response", "OBJECT<prompt: STRING, response: STRING>", _said(("user", _field("$.prompt")), ("assistant", _field("$.response")))),
    Mapping("prompt_completion", "OBJECT<completion: STRING, prompt: STRING>", _said(("user", _field("$.prompt")), ("assistant", _field("$.completion")))),
    Mapping("question_answer", "OBJECT<answer: STRING, question: STRING>", _said(("user", _field("$.question")), ("assistant", _field("$.answer")))),
    Mapping("instruction", "OBJECT<instruction: STRING, output: STRING>", _said(("user", _field("$.instruction")), ("assistant", _field("$.output")))),
    Mapping(
        "instruction_input",
        "OBJECT<input: STRING, instruction: STRING, output: STRING>",
        lambda v: F.array(
            F.struct(F.lit("user").alias("role"), F.concat_ws("\n", F.nullif(_field("$.instruction")(v), F.lit("")), F.nullif(_field("$.input")(v), F.lit(""))).alias("text")),
            F.struct(F.lit("assistant").alias("role"), _field("$.output")(v).alias("text")),
        ),
    ),
    Mapping("messages", "OBJECT<messages: ARRAY<OBJECT<content: STRING, role: STRING>>>", _listed("$.messages", "role", "content")),
    Mapping("from_value", "OBJECT<conversations: ARRAY<OBJECT<from: STRING, value: STRING>>>", _listed("$.conversations", "from", "value", {"human": "user", "gpt": "assistant"})),
    Mapping("bare_messages", "ARRAY<OBJECT<content: STRING, role: STRING>>", _listed("$", "role", "content")),
)


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths and types of a variant record."""
    return F.md5(F.schema_of_variant(record))


#: Layouts with one record a turn: the columns that hold its place, role and text.
ROW_LAYOUTS = (("turn", "role", "text"), ("position", "role", "content"))


def row_shapes(names: tuple[str, str, str]) -> list[str]:
    """Variant types of one-turn records: a null has a type of its own."""
    kinds = dict(zip(names, ("BIGINT", "STRING", "STRING"), strict=True))
    every = itertools.product(*[(f"{n}: {kinds[n]}", f"{n}: VOID") for n in sorted(names)])
    return ["OBJECT<" + ", ".join(fields) + ">" for fields in every]


def turns_of_rows(df: DataFrame, conv: str) -> DataFrame:
    """Canonical turns (conv, turn, role, text) of a table with one row per turn.

    The columns of a layout become a record, of which the fingerprint picks the mapping, row by row. Columns
    beyond the layout are ignored; a table that holds none, or rows of other types, are refused.
    """
    found = [names for names in ROW_LAYOUTS if set(names) <= set(df.columns)]
    if not found:
        raise ValueError("no known layout of turns: " + ", ".join(df.columns))
    turn, role, text = found[0]
    record = F.to_variant_object(F.struct(*[F.col(n).alias(n) for n in found[0]]))
    rows = df.select(F.col(conv).alias("conv_id"), record.alias("v"))
    known = [hashlib.md5(shape.encode()).hexdigest() for shape in row_shapes(found[0])]
    said = F.struct(
        F.try_variant_get("v", f"$.{turn}", "bigint").alias("turn"), F.try_variant_get("v", f"$.{role}", "string").alias("role"), F.try_variant_get("v", f"$.{text}", "string").alias("text")
    )
    refused = F.raise_error(F.concat(F.lit("no mapping for records of the type "), F.schema_of_variant("v"))).cast("struct<turn:bigint,role:string,text:string>")
    return rows.select("conv_id", F.when(fingerprint(F.col("v")).isin(known), said).otherwise(refused).alias("said")).select("conv_id", "said.*")


def turns_of_records(df: DataFrame, conv: str, record: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Canonical turns of JSON records of mixed layouts; the fingerprint picks each record's mapping."""
    v = F.try_parse_json(F.col(record))
    rows = df.select(F.col(conv).alias("conv_id"), v.alias("v"), fingerprint(v).alias("fp"))
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for m in mappings:
        turns = F.when(F.col("fp") == m.fingerprint, m.turns(F.col("v"))).otherwise(turns)
    said = rows.select("conv_id", F.posexplode(turns).alias("turn", "said"))
    return said.select("conv_id", F.col("turn").cast("long").alias("turn"), "said.role", "said.text")


def unmatched(df: DataFrame, record: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Records that no mapping fits, with their fingerprint (null: invalid JSON)."""
    fp = fingerprint(F.try_parse_json(F.col(record)))
    return df.withColumn("fingerprint", fp).where(~F.coalesce(F.col("fingerprint").isin([m.fingerprint for m in mappings]), F.lit(False)))


def render(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss_runs): one string a conversation, and its loss mask in code points.

    ``loss_runs`` has one entry a turn: ``skip`` code points from the turn's start are outside the
    mask, the next ``take`` are inside, the rest of the turn is outside.
    """
    role, text = escape_role(F.col("role")), escape_text(F.col("text"))
    lines = turns.select(
        "conv_id",
        F.struct(
            "turn",
            "role",
            "text",
            F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END)).alias("segment"),
            (F.length(role) + len(START) + 1).cast("long").alias("skip"),
            F.when(F.coalesce(F.col("role").isin(list(loss_roles)), F.lit(False)), F.length(text)).otherwise(0).cast("long").alias("take"),
        ).alias("said"),
    )
    packed = lines.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    return packed.select(
        "conv_id",
        F.array_join(F.transform("said", lambda x: x["segment"]), "").alias("formatted"),
        F.transform("said", lambda x: F.struct(x["skip"].alias("skip"), x["take"].alias("take"))).alias("loss_runs"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_text, formatted) from formatted strings and masks."""
    chunks = F.slice(F.split("formatted", r"<\|im_end\|>\n"), 1, F.size("loss_runs"))
    cut = rendered.withColumn("chunk", chunks)
    said = F.transform("chunk", lambda c: F.substr(c, F.lit(len(START) + 1)))
    turn = lambda c: F.struct(
        unescape(F.substring_index(c, "\n", 1)).alias("role"),
        unescape(F.substr(c, F.length(F.substring_index(c, "\n", 1)) + 2)).alias("text"),
    )
    masked = F.zip_with("chunk", "loss_runs", lambda c, r: unescape(F.substr(c, (r["skip"] + 1).cast("int"), r["take"].cast("int"))))
    return cut.select("conv_id", F.transform(said, turn).alias("turns"), F.array_join(masked, "").alias("loss_text"), "formatted")
