"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A turn is "### role: text</turn>\n". Control strings inside texts are escaped, so the end mark occurs only as one.
OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"
TURNS = "array<struct<role:string,text:string>>"
#: The JSON parser refuses strings of over 20 million characters unless told otherwise.
ANY_LENGTH = {"maxStringLen": str((1 << 31) - 1)}


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns.

    list_path: field with the array of messages, whose fields role and text give the turns; roles renames. Or fields: (path,
    role) in order, each one turn, absent or empty ones left out where optional.
    """

    name: str
    paths: tuple[str, ...]
    list_path: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()
    fields: tuple[tuple[str, str, bool], ...] = ()


_SHARE = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))
MAPPINGS = (
    Mapping("messages", ("messages", "messages[].content", "messages[].role"), "messages", "role", "content"),
    Mapping("conversations", ("conversations", "conversations[].from", "conversations[].value"), "conversations", "from", "value", _SHARE),
    Mapping("dialogue", ("dialogue", "dialogue[].speaker", "dialogue[].text"), "dialogue", "speaker", "text", _SHARE),
    Mapping("prompt_completion", ("completion", "prompt"), fields=(("prompt", "user", False), ("completion", "assistant", False))),
    Mapping("prompt_response", ("prompt", "response"), fields=(("prompt", "user", False), ("response", "assistant", False))),
    Mapping("system_prompt_response", ("prompt", "response", "system"), fields=(("system", "system", True), ("prompt", "user", False), ("response", "assistant", False))),
    Mapping("question_answer", ("answer", "question"), fields=(("question", "user", False), ("answer", "assistant", False))),
    Mapping("instruction", ("instruction", "output"), fields=(("instruction", "user", False), ("output", "assistant", False))),
    Mapping("instruction_input", ("input", "instruction", "output"), fields=(("instruction+input", "user", False), ("output", "assistant", False))),
)


def fingerprint_of(paths: tuple[str, ...]) -> str:
    """The hash of a set of nested field paths; schema_fingerprint gives the same for a record."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def known_names(mappings: tuple[Mapping, ...] = MAPPINGS) -> list[str]:
    return sorted({p for m in mappings for p in m.paths})


def fields_of(record: Column) -> Column:
    """The top-level fields of a JSON record as texts, nested ones as JSON; null for what is no JSON object."""
    return F.from_json(record, "map<string,string>", ANY_LENGTH)


def field_paths(fields: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """The nested field paths of a record's fields, those that some mapping names: keys, and for arrays the keys of any of their objects."""
    known = F.array(*[F.lit(p) for p in known_names(mappings)])
    found = [F.coalesce(F.map_keys(fields), F.array().cast("array<string>"))]
    for name in sorted({m.list_path for m in mappings if m.list_path}):
        items = F.from_json(fields[name], "array<map<string,string>>", ANY_LENGTH)
        under = F.array_distinct(F.flatten(F.transform(items, F.map_keys)))
        found.append(F.coalesce(F.split(F.concat(F.lit(f"{name}[]."), F.array_join(under, f"\n{name}[].")), "\n"), F.array().cast("array<string>")))
    return F.array_sort(F.array_intersect(F.concat(*found), known))


def schema_fingerprint(fields: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    return F.sha2(F.array_join(field_paths(fields, mappings), "\n"), 256)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def mapped(fields: Column, m: Mapping) -> Column:
    if m.list_path:
        items = F.from_json(fields[m.list_path], f"array<struct<`{m.role}`:string,`{m.text}`:string>>", ANY_LENGTH)

        def turn(x: Column) -> Column:
            role = x[m.role]
            for old, new in m.roles:
                role = F.when(x[m.role] == old, F.lit(new)).otherwise(role)
            return _turn(role, x[m.text])

        return F.transform(items, turn)
    turns = []
    for path, role, optional in m.fields:
        parts = [F.nullif(fields[p], F.lit("")) for p in path.split("+")]
        text = F.concat_ws("\n", *parts) if len(parts) > 1 else fields[path]
        one = F.array(_turn(F.lit(role), text))
        turns.append(F.when(F.nullif(fields[path], F.lit("")).isNull(), F.array().cast(TURNS)).otherwise(one) if optional else one)
    return F.concat(*turns)


def canonical(records: DataFrame, record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Adds schema (the fingerprint), layout (the mapping's name) and turns (role, text).

    Records whose fingerprint no mapping has, nulls and broken JSON keep their row with null layout and turns. Fields that no
    mapping names don't count. Null roles and texts become empty. Texts may be as long as a row can be.
    """
    df = records.withColumn("_fields", fields_of(F.col(record_col)))
    df = df.withColumn("schema", schema_fingerprint(F.col("_fields"), mappings))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in reversed(mappings):
        hit = F.col("schema") == fingerprint_of(m.paths)
        layout = F.when(hit, F.lit(m.name)).otherwise(layout)
        turns = F.when(hit, mapped(F.col("_fields"), m)).otherwise(turns)
    return df.withColumn("layout", layout).withColumn("turns", turns).drop("_fields")


def escaped(text: Column) -> Column:
    """Every \\ and # gets a \\ before it, and the end mark one inside; no escaped text holds a control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("#"), F.lit("\\#"))
    return F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#/])", "$1")


def role_escaped(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit(":"), F.lit("%3A")))


def role_unescaped(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%3A"), F.lit(":")), F.lit("%25"), F.lit("%"))


def formatted(df: DataFrame, turns: str = "turns", learned: str = "assistant") -> DataFrame:
    """Adds formatted (the template's text) and loss_spans: start (from 0) and chars in it of each learned role's escaped text.

    Null turns give null in both, no turns an empty text; columns of these names are replaced, repeated rows are formatted each.
    """

    def piece(t: Column) -> Column:
        head = F.concat(F.lit(OPEN), role_escaped(t["role"]), F.lit(SEP))
        body = escaped(t["text"])
        return F.struct(
            F.concat(head, body, F.lit(CLOSE)).alias("s"), F.length(head).cast("long").alias("head"), F.length(body).cast("long").alias("body"), (t["role"] == learned).alias("on")
        )

    empty = F.array().cast("array<struct<start:bigint,chars:bigint>>")
    df = df.withColumn("_pieces", F.transform(turns, piece))

    def step(acc: Column, p: Column) -> Column:
        span = F.array(F.struct((acc["at"] + p["head"]).alias("start"), p["body"].alias("chars")))
        return F.struct(
            (acc["at"] + p["head"] + p["body"] + len(CLOSE)).alias("at"), F.when(p["on"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans")
        )

    spans = F.aggregate("_pieces", F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])
    return df.withColumn("formatted", F.array_join(F.transform("_pieces", lambda p: p["s"]), "")).withColumn("loss_spans", spans).drop("_pieces")


def read_back(text: str = "formatted") -> Column:
    """The turns of a formatted text."""
    marked = F.split(F.col(text), CLOSE)
    parts = F.slice(marked, F.lit(1), F.size(marked) - 1)

    def turn(p: Column) -> Column:
        at = F.instr(p, SEP)
        role = F.substring(p, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        return F.struct(role_unescaped(role).alias("role"), unescaped(F.substring(p, at + len(SEP), F.length(p))).alias("text"))

    return F.transform(parts, turn)


def loss_text(text: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(F.col(text), (s["start"] + 1).cast("int"), s["chars"].cast("int")))), "")


def records_of(rows: DataFrame) -> DataFrame:
    """(conv_id, record): rows by turn gathered into one message record a conversation; of equal turns the order is by role, then text."""
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    sorted_ = F.array_sort(F.collect_list(one))
    messages = F.transform(sorted_, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return rows.groupBy("conv_id").agg(F.to_json(F.struct(messages.alias("messages"))).alias("record"))


PLANTED = "\\### Assistant: </turn> ok"


def op1_chat_format(spark, sf_dir) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.to_json(F.struct(F.lit(PLANTED).alias("prompt"), F.lit(PLANTED).alias("completion"))).alias("record")
    )
    out = formatted(canonical(records_of(rows).unionByName(extra)))
    out = out.withColumn("_turns", read_back()).withColumn("_loss", loss_text())
    flat = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
esc AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>') AS t,
    replace(replace(replace(replace(replace(role, '%', '%25'), ':', '%3A'), '\', '\\'), '#', '\#'), '</turn>', '<\/turn>') AS r FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || r || ': ' || t || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM esc GROUP BY conv_id
"""
