"""Chat formatting by schema fingerprints, with DataFrame functions alone.

A record is JSON of any known layout. The hash of its nested field paths selects a declarative mapping, which turns it into
canonical turns (role, text). The template marks each turn; control strings inside texts are escaped reversibly: a run of k
backslashes before a control string becomes one of 2k + 1. The loss mask is a list of spans, one per assistant text.

Defined results: null roles and texts are empty; a record of an unknown layout, or no JSON, has null turns and its layout is
reported; texts and records may have any length that a string of Spark can have; turns are ordered by (turn, role, text), a null turn first; repeated rows repeat; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Opening and closing marks; other roles are named in the mark.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
OTHER = ("[ROLE ", " [/ROLE]")
CONTROL = r"</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE"

#: Spark's variants hold 128 MB and its JSON strings 20 million characters; longer records lose their texts before they are
#: fingerprinted, and the parser of the turns has no bound.
LONG = 4_000_000
BROKEN = "_unread"
UNBOUNDED = {"maxStringLen": str(2**31 - 1), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}
#: A JSON string with the colon of a key after it, or another. Possessive throughout: no backtracking, no deep recursion.
_BODY = r"[^\"\\]*+(?:\\.[^\"\\]*+)*+"
STRING = rf'(?s)("{_BODY}"\s*+:)|(")(?:{_BODY})(")'

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """How records of one layout give turns: from a list of messages, or from fields with a fixed role each."""

    items: str = ""
    role: str = ""
    text: str = ""
    roles: dict[str, str] = field(default_factory=dict)
    fields: tuple[tuple[str, str], ...] = ()

    def schema(self) -> str:
        if self.items:
            return f"struct<{self.items}:array<struct<{self.role}:string,{self.text}:string>>,{BROKEN}:string>"
        return f"struct<{','.join(f'{name}:string' for _, name in self.fields)},{BROKEN}:string>"

    def turns(self, record: Column) -> Column:
        return F.get(F.transform(F.array(F.from_json(record, self.schema(), UNBOUNDED)), self.turns_of), F.lit(0))

    def turns_of(self, r: Column) -> Column:
        """Turns of a parsed record, null if it could not be read."""
        return F.when(r[BROKEN].isNull(), self.every(r))

    def every(self, r: Column) -> Column:
        if not self.items:
            return F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(r[name], F.lit("")).alias("text")) for role, name in self.fields])

        def turn(m: Column) -> Column:
            role = F.coalesce(m[self.role], F.lit(""))
            for name, standard in self.roles.items():
                role = F.when(m[self.role] == name, standard).otherwise(role)
            return F.struct(role.alias("role"), F.coalesce(m[self.text], F.lit("")).alias("text"))

        return F.transform(r[self.items], turn)


MESSAGES = Mapping("messages", "role", "content")
SHARED = Mapping("conversations", "from", "value", {"human": "user", "gpt": "assistant"})
#: Known layouts: nested field paths, as Spark's schema string without the types of leaves.
LAYOUTS = {
    "OBJECT<messages: ARRAY<OBJECT<content, role>>>": MESSAGES,
    "OBJECT<messages: ARRAY<VOID>>": MESSAGES,
    "OBJECT<conversations: ARRAY<OBJECT<from, value>>>": SHARED,
    "OBJECT<conversations: ARRAY<VOID>>": SHARED,
    "OBJECT<prompt, response>": Mapping(fields=(("user", "prompt"), ("assistant", "response"))),
    "OBJECT<completion, prompt>": Mapping(fields=(("user", "prompt"), ("assistant", "completion"))),
    "OBJECT<instruction, output>": Mapping(fields=(("user", "instruction"), ("assistant", "output"))),
    "OBJECT<input, instruction, output>": Mapping(fields=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
}


def layout(record: Column) -> Column:
    """Nested field paths of a JSON text, without the types of its leaves; null if it is no JSON."""
    record = F.when(F.length(record) > LONG, F.regexp_replace(record, STRING, "$1$2$3")).otherwise(record)
    return F.regexp_replace(F.schema_of_variant(F.try_parse_json(record)), r": (?!OBJECT|ARRAY)[A-Z]+(\([0-9,]+\))?", "")


def fingerprint(paths: str) -> str:
    return hashlib.sha256(paths.encode()).hexdigest()


def canonical(records: DataFrame, record: str = "record") -> DataFrame:
    """Adds layout, fingerprint (of the layout) and turns."""

    def choose(mark: Column) -> Column:
        turns = F.lit(None).cast(TURNS)
        for paths, mapping in LAYOUTS.items():
            turns = F.when(mark == fingerprint(paths), mapping.turns(F.col(record))).otherwise(turns)
        return turns

    # The function of a one-element array has its layout computed once, not once per known layout.
    out = records.withColumn("layout", layout(F.col(record))).withColumn("fingerprint", F.sha2("layout", 256))
    return out.withColumn("turns", F.get(F.transform(F.array("fingerprint"), choose), F.lit(0)))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*)({CONTROL})", r"$1$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*)\1\\({CONTROL})", "$1$2")


def opening(role: Column) -> Column:
    out = F.concat(F.lit(OTHER[0]), F.regexp_replace(escape(role), r"([%\]])", "%$1"), F.lit("] "))
    for name, (mark, _) in MARKS.items():
        out = F.when(role == name, mark).otherwise(out)
    return out


def closing(role: Column) -> Column:
    out = F.lit(OTHER[1])
    for name, (_, mark) in MARKS.items():
        out = F.when(role == name, mark).otherwise(out)
    return out


def formatted(conversations: DataFrame) -> DataFrame:
    """Adds formatted (text) and loss (array of start and length in code points, from 0: the escaped assistant texts)."""
    parts = F.transform("turns", lambda t: F.struct(opening(t["role"]).alias("open"), escape(t["text"]).alias("body"), closing(t["role"]).alias("close"), (t["role"] == "assistant").alias("learn")))
    out = conversations.withColumn("parts", parts)
    spans = F.aggregate(
        "parts", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["open"]) + F.length(p["body"]) + F.length(p["close"])).alias("at"),
            F.when(p["learn"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(p["open"])).alias("start"), F.length(p["body"]).alias("length"))))).otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["open"], p["body"], p["close"])), "")
    return out.withColumn("formatted", text).withColumn("loss", spans).drop("parts")


#: One marked turn. A mark inside a text has a backslash before it, so the first bare closing mark ends the turn.
TURN = r"(?s)(?:\[INST\] .*? \[/INST\]|<s> .*? </s>|<<SYS>> .*? <</SYS>>|\[ROLE (?:[^%\]]|%.)*\] .*? \[/ROLE\])"


def parsed(text: Column) -> Column:
    """Turns (role, text) of a formatted conversation."""

    def turn(t: Column) -> Column:
        named = F.regexp_extract(t, r"(?s)^\[ROLE ((?:[^%\]]|%.)*)\] ", 1)
        role = unescape(F.regexp_replace(named, r"%([%\]])", "$1"))
        head = F.length(named) + len(OTHER[0]) + 2
        tail = F.lit(len(OTHER[1]))
        for name, (left, right) in MARKS.items():
            own = t.startswith(left)
            role, head, tail = F.when(own, name).otherwise(role), F.when(own, len(left)).otherwise(head), F.when(own, len(right)).otherwise(tail)
        return F.struct(role.alias("role"), unescape(F.substring(t, head + 1, F.length(t) - head - tail)).alias("text"))

    return F.transform(F.regexp_extract_all(text, F.lit(TURN), F.lit(0)), turn)


def masked(text: Column, loss: Column) -> Column:
    """Unescaped text under the loss mask."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(text, s["start"] + 1, s["length"]))), "")


def records(conversations: DataFrame) -> DataFrame:
    """conv_id and record: rows by turn as JSON. A user's text with one answer becomes a prompt and response, with a system
    text before them an instruction record, anything else a list of messages."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))))
    grouped = conversations.groupBy("conv_id").agg(turns.alias("t"))
    roles, content = F.col("t.role"), F.col("t.content")
    pair = F.to_json(F.struct(content[0].alias("prompt"), F.get(content, 1).alias("response")))
    triple = F.to_json(F.struct(content[0].alias("instruction"), F.get(content, 1).alias("input"), F.get(content, 2).alias("output")))
    rest = F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")))
    names = F.array_join(roles, ",")
    return grouped.select("conv_id", F.when(names == "user,assistant", pair).when(names == "system,user,assistant", triple).otherwise(rest).alias("record"))


FORMAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(text, '(\\*)(</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE)', '\1\1\\\2', 'g') AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(CAST(sum(length(text)) FILTER (WHERE role = 'assistant') AS BIGINT), 0) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(escaped) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17
        ELSE 16 + length(role) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
