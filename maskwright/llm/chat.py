"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns.

DataFrame functions only. A record is JSON of any layout. Its fingerprint is a hash of
its nested field paths, found row by row; it selects one of the layouts, each of which
says where roles and texts stand. The canonical turns are written into a template that
marks turns and escapes control strings inside texts, so that the turns, and the loss
mask over the assistant's texts, can be read back from the output alone.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


class Layout(NamedTuple):
    """Either `turns`: a list's path, with the fields of role and text in its items; or `fields`: (role, path) in order."""

    schema: str  # an example of the field paths, as JSON
    turns: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()


_USER, _ASSISTANT, _SYSTEM = "user", "assistant", "system"

LAYOUTS = (
    Layout('{"messages":[{"content":"","role":""}]}', turns=("$.messages", "role", "content")),
    Layout('{"conversations":[{"from":"","value":""}]}', turns=("$.conversations", "from", "value")),
    Layout('{"dialog":{"turns":[{"speaker":"","text":""}]}}', turns=("$.dialog.turns", "speaker", "text")),
    Layout('{"content":"","role":""}', fields=(("$.role", "$.content"),)),
    Layout('{"completion":"","prompt":""}', fields=((_USER, "$.prompt"), (_ASSISTANT, "$.completion"))),
    Layout('{"prompt":"","response":""}', fields=((_USER, "$.prompt"), (_ASSISTANT, "$.response"))),
    Layout('{"prompt":"","response":"","system":""}', fields=((_SYSTEM, "$.system"), (_USER, "$.prompt"), (_ASSISTANT, "$.response"))),
    Layout('{"instruction":"","output":""}', fields=((_USER, "$.instruction"), (_ASSISTANT, "$.output"))),
    Layout('{"input":"","instruction":"","output":""}', fields=((_USER, "$.instruction+$.input"), (_ASSISTANT, "$.output"))),
    Layout('{"answer":"","question":""}', fields=((_USER, "$.question"), (_ASSISTANT, "$.answer"))),
)

#: Other names of the roles, for layouts that list turns.
ROLE_NAMES = {"human": _USER, "gpt": _ASSISTANT, "bot": _ASSISTANT, "model": _ASSISTANT}

START, END = "<|im_start|>", "<|im_end|>\n"
#: Strings that are broken up inside texts. Every mark begins with the first.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

#: Characters of a text that go into a record's JSON; Spark's parser ends somewhat later.
MOST_JSON = 10_000_000

_TURNS = "array<struct<role:string,text:string>>"


def field_paths(record: Column) -> Column:
    """The nested field paths of a variant, whatever the kinds of its values."""
    return F.regexp_replace(F.schema_of_variant(record), ": (?!OBJECT|ARRAY)[A-Z]+(\\([0-9, ]*\\))?", "")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(field_paths(record))


def canonical_turns(payload: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Turns (array of role, text) of a JSON record; null where no layout has its field paths, or it isn't JSON.

    Null texts and roles are empty; an empty list of turns has no item paths, and so no layout.
    """
    record = F.try_parse_json(payload)
    mark = fingerprint(record)
    found: Column | None = None
    for layout in layouts:
        if layout.turns:
            turns = _listed(record, *layout.turns)
        else:
            turns = F.array(*[F.struct(_at(record, role).alias("role"), _text(record, path).alias("text")) for role, path in layout.fields])
        same = mark == fingerprint(F.parse_json(F.lit(layout.schema)))
        found = F.when(same, turns) if found is None else found.when(same, turns)
    return found.cast(_TURNS) if found is not None else F.lit(None).cast(_TURNS)


def _listed(record: Column, path: str, role: str, text: str) -> Column:
    items = F.try_variant_get(record, path, f"array<struct<`{role}`:string,`{text}`:string>>")
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    return F.transform(items, lambda t: F.struct(F.coalesce(F.try_element_at(names, t[role]), t[role], F.lit("")).alias("role"), F.coalesce(t[text], F.lit("")).alias("text")))


def _at(record: Column, role: str) -> Column:
    return F.coalesce(F.try_variant_get(record, role, "string"), F.lit("")) if role.startswith("$") else F.lit(role)


def _text(record: Column, path: str) -> Column:
    """One field, or several of which those that hold something stand one under the other."""
    parts = [F.coalesce(F.try_variant_get(record, p, "string"), F.lit("")) for p in path.split("+")]
    return parts[0] if len(parts) == 1 else F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "\n\n")


def escaped(text: Column) -> Column:
    """Backslashes doubled; one put after the first character of each control string."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        text = F.replace(text, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def formatted(turns: Column) -> Column:
    """One string of all turns. Roles stand percent-encoded on the line of the mark, texts escaped below."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n"), escaped(t["text"]), F.lit(END))), "")


def pieces(output: DataFrame) -> DataFrame:
    """conv_id, at (number of the turn), start (of its mark in the formatted string, in code points), head (encoded role), body (escaped text) and piece (what follows the mark)."""
    raw = F.slice(F.split("formatted", "<\\|im_start\\|>", -1), 2, 2**31 - 2)
    cut = output.select("conv_id", F.posexplode(raw).alias("at", "piece"))
    head = F.substring_index("piece", "\n", 1)
    cut = cut.withColumn("head", head).withColumn("size", F.length("piece") + len(START))
    cut = cut.withColumn("body", F.substr("piece", F.length("head") + 2, F.col("size") - F.length("head") - F.lit(1 + len(START) + len(END))))
    before = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("bigint"))


def loss_mask(cut: DataFrame) -> DataFrame:
    """pieces with loss_start and loss_end: where the formatted string holds an assistant's text, escaped as it stands; null in other turns."""
    begin = F.col("start") + F.lit(len(START) + 1) + F.length("head")
    learned = F.col("head") == _ASSISTANT
    return cut.withColumn("loss_start", F.when(learned, begin)).withColumn("loss_end", F.when(learned, begin + F.length("body")))


def conversations(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """conv_id and formatted, the whole conversation, from records: conv_id, turn, payload (JSON).

    Records are put together by conv_id in the order of turn, then of their turns'
    places; ties go by role and text. Records of no known layout add nothing; a
    conversation of nothing else does not appear. A null conv_id is one of its own.
    Repeated rows repeat their turns. JSON strings end at MOST_JSON characters: a longer
    text stands in the column long_text, where there is one, and takes the place of its
    record's last text. Other columns are not read.
    """
    long_text = F.col("long_text") if "long_text" in records.columns else F.lit(None).cast("string")
    found = canonical_turns(F.col("payload"), layouts)
    turns = records.select("conv_id", "turn", long_text.alias("long_text"), F.posexplode(found).alias("place", "t"), F.size(found).alias("of"))
    text = F.when(F.col("place") == F.col("of") - 1, F.coalesce("long_text", "t.text")).otherwise(F.col("t.text"))
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "place", "t.role", text.alias("text")))).alias("turns"))
    return ordered.select("conv_id", formatted(F.col("turns")).alias("formatted"))


def digests(output: DataFrame) -> DataFrame:
    """What the formatted strings hold, read back from them alone; the loss is cut out by its mask.

    loss_spans: the mask, as start:end of each assistant's text, joined by commas.
    """
    cut = loss_mask(pieces(output))
    learned = F.substr("piece", (F.col("loss_start") - F.col("start") + F.lit(1 - len(START))).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    line = F.concat(F.url_decode("head"), F.lit("\n"), unescaped(F.col("body")), F.lit("\n"))
    turn = F.struct("at", line.alias("line"), unescaped(learned).alias("loss"), F.concat_ws(":", "loss_start", "loss_end").alias("span"), F.col("loss_start").isNotNull().alias("own"))
    back = cut.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.sum("size").alias("formatted_chars"))
    owned = F.filter("turns", lambda t: t["own"])
    loss = F.array_join(F.transform(owned, lambda t: t["loss"]), "")
    lines = F.array_join(F.transform("turns", lambda t: t["line"]), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("bigint").alias("formatted_chars"), F.array_join(F.transform(owned, lambda t: t["span"]), ",").alias("loss_spans"),
    )


_TRIAL = "</s>[INST] ok [/INST]"


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    long = F.length("text") > MOST_JSON
    payload = F.to_json(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.when(long, "").otherwise(F.coalesce("text", F.lit(""))).alias("content")))
    records = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), payload.alias("payload"), F.when(long, F.col("text")).alias("long_text"))
    trial = spark.range(1).select(F.lit(-1).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"), F.to_json(F.struct(F.lit(_TRIAL).alias("prompt"), F.lit(_TRIAL).alias("completion"))).alias("payload"), F.lit(None).cast("string").alias("long_text"))
    return digests(conversations(records.union(trial)))


def _escaped_sql(text: str) -> str:
    text = f"replace({text}, '\\', '\\\\')"
    for control in CONTROLS:
        text = f"replace({text}, '{control}', '{control[0]}\\{control[1:]}')"
    return text


ORACLE = f"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '{_TRIAL}' union all select -1, 1, 'assistant', '{_TRIAL}'
), sized as (
    select *, {len(START) + 1} + length(url_encode(role)) as lead, length({_escaped_sql('text')}) as body from turns
), placed as (
    select *, coalesce(sum(lead + body + {len(END)}) over (partition by conv_id order by turn, role, text rows between unbounded preceding and 1 preceding), 0) + lead as here from sized
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
    cast(sum(lead + body + {len(END)}) as bigint) as formatted_chars,
    coalesce(string_agg(cast(here as varchar) || ':' || cast(here + body as varchar), ',' order by turn, role, text) filter (where role = 'assistant'), '') as loss_spans
from placed group by conv_id
"""
