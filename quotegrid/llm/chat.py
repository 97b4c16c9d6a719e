"""Chat formatting: records of any known layout become canonical turns, and
turns become one training text for each conversation with a loss mask.

A record's layout is told by its schema fingerprint: the hash of the nested
field paths that it has (``messages[].role``), of those that any layout names.
A layout is a declaration: the paths it must and may have, and the turns they
make. Everything is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations
from re import escape as quoted

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

c = F.col


@dataclass(frozen=True)
class Turn:
    """One turn of a fixed role, whose text is the fields that are there, with a blank line between."""

    role: str
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Each:
    """A turn for each member of a list, in its order."""

    items: str
    role: str
    text: str


@dataclass(frozen=True)
class Layout:
    name: str
    needs: tuple[str, ...]
    turns: tuple[Turn | Each, ...]
    may: tuple[str, ...] = ()
    #: A row is a turn, not a conversation; its fields are needs in the order turn, role, text.
    by_row: bool = False


_SYSTEM = Turn("system", ("system",))
LAYOUTS = (
    Layout("turn_rows", ("turn", "role", "text"), (), by_row=True),
    Layout("turn_rows_content", ("turn", "role", "content"), (), by_row=True),
    Layout("messages", ("messages", "messages[].role", "messages[].content"), (_SYSTEM, Each("messages", "role", "content")), ("system",)),
    Layout("from_value", ("conversations", "conversations[].from", "conversations[].value"), (_SYSTEM, Each("conversations", "from", "value")), ("system",)),
    Layout("instruction_output", ("instruction", "output"), (_SYSTEM, Turn("user", ("instruction", "input")), Turn("assistant", ("output",))), ("system", "input")),
    Layout("instruction_response", ("instruction", "response"), (_SYSTEM, Turn("user", ("instruction", "context")), Turn("assistant", ("response",))), ("system", "context")),
    Layout("prompt_completion", ("prompt", "completion"), (_SYSTEM, Turn("user", ("prompt",)), Turn("assistant", ("completion",))), ("system",)),
    Layout("prompt_response", ("prompt", "response"), (_SYSTEM, Turn("user", ("prompt",)), Turn("assistant", ("response",))), ("system",)),
    Layout("question_answer", ("question", "answer"), (_SYSTEM, Turn("user", ("question", "context")), Turn("assistant", ("answer",))), ("system", "context")),
)
#: What lists of ``from`` and ``value`` call the roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "chatgpt": "assistant", "bot": "assistant", "model": "assistant"}

# Control strings of common templates; the first three are this template's own.
START, BETWEEN, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = (START, BETWEEN, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"


def _fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(F.array_sort(paths), "\n"))


def known_paths(layouts: Sequence[Layout] = LAYOUTS) -> list[str]:
    return sorted({p for x in layouts for p in (*x.needs, *x.may)})


def path_sets(layouts: Sequence[Layout] = LAYOUTS) -> list[tuple[str, Layout]]:
    """Each set of paths that a layout may have (joined in order), with its layout; no two layouts share one."""
    out = [("\n".join(sorted({*x.needs, *some})), x) for x in layouts for n in range(len(x.may) + 1) for some in combinations(x.may, n)]
    if len({p for p, _ in out}) < len(out):
        raise ValueError("two layouts have the same paths")
    return out


def schema_paths(schema: T.StructType, before: str = "") -> list[str]:
    """The nested field paths of a table."""
    out = []
    for f in schema.fields:
        path, kind = before + f.name, f.dataType
        out.append(path)
        while isinstance(kind, T.ArrayType):
            path, kind = f"{path}[]", kind.elementType
        if isinstance(kind, T.StructType):
            out += schema_paths(kind, f"{path}.")
    return out


def _record_paths(record: Column, layouts: Sequence[Layout]) -> Column:
    """The known paths of a record (a map of names to JSON texts), null values' too."""
    known, parts = known_paths(layouts), [F.map_keys(record)]
    for items in sorted({p.split("[].")[0] for p in known if "[]." in p}):
        names = F.flatten(F.transform(_list(record, items), lambda x: F.map_keys(x)))
        parts.append(F.transform(F.array_distinct(names), _below(items)))
    found = F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts])
    return F.array_intersect(found, F.array(*map(F.lit, known)))


def _below(items: str):
    return lambda name: F.concat(F.lit(f"{items}[]."), name)


def _list(record: Column, items: str) -> Column:
    return F.filter(F.from_json(record[items], "array<map<string,string>>"), lambda x: x.isNotNull())


def _member(each: Each):
    """A list's member as a turn."""
    names = F.create_map(*[F.lit(x) for kv in ROLE_NAMES.items() for x in kv])

    def turn(x: Column) -> Column:
        role = x[each.role]
        if each.role == "from":
            role = F.coalesce(names[F.coalesce(role, F.lit(""))], role)
        return F.struct(role.alias("role"), x[each.text].alias("text"))

    return turn


def _turns_of(record: Column, layout: Layout) -> Column:
    parts = []
    for t in layout.turns:
        if isinstance(t, Turn):
            text = F.array_join(F.filter(F.array(*[record[f] for f in t.fields]), lambda x: x.isNotNull()), "\n\n")
            turn = F.array(F.struct(F.lit(t.role).alias("role"), text.alias("text")))
            given = [record[f].isNotNull() for f in t.fields if f in layout.may]
            parts.append(turn if len(given) < len(t.fields) else F.when(given[0], turn).otherwise(F.filter(turn, lambda x: F.lit(False))))
        else:
            parts.append(F.transform(_list(record, t.items), _member(t)))
    return F.concat(*parts)


def record_turns(records: DataFrame, record: Column, conv_id: Column, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """(conv_id, layout, turns) of JSON records, one conversation each. A record of
    no known layout - malformed, or with the paths of two - has neither layout nor turns."""
    sets = [(p, x) for p, x in path_sets(layouts) if not x.by_row]
    mapped = records.select(conv_id.alias("conv_id"), F.from_json(record, "map<string,string>").alias("r"))
    marked = mapped.withColumn("mark", _fingerprint(_record_paths(c("r"), layouts)))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for x in dict.fromkeys(x for _, x in sets):
        own = c("mark").isin([_literal_mark(records, p) for p, y in sets if y is x])
        layout, turns = F.when(own, F.lit(x.name)).otherwise(layout), F.when(own, _turns_of(c("r"), x)).otherwise(turns)
    return marked.select("conv_id", layout.alias("layout"), turns.alias("turns"))


_marks: dict[str, int] = {}


def _literal_mark(df: DataFrame, paths: str) -> int:
    if paths not in _marks:
        known = [p for p, _ in path_sets()] if not _marks else [paths]
        row = df.sparkSession.range(1).select(*[F.xxhash64(F.lit(p)).alias(str(i)) for i, p in enumerate({*known, paths})]).first()
        _marks.update(zip({*known, paths}, row))
    return _marks[paths]


def canonical(table: DataFrame, conv_id: str = "conv_id", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """(conv_id, turn, role, text) of a table whose rows are turns or whole
    conversations; the layout of rows is told by the table's own paths, that of
    conversations record by record, so one table may hold many layouts (columns
    that are null don't count then). Records of no known layout give no turn:
    ``record_turns`` names them. Other columns are left alone.
    """
    known = set(known_paths(layouts))
    mine = [p for p in schema_paths(table.schema) if p in known]
    rows = {p: x for p, x in path_sets(layouts) if x.by_row}.get("\n".join(sorted(mine)))
    if rows:
        turn, role, text = rows.needs
        return table.select(c(conv_id).cast("long").alias("conv_id"), c(turn).cast("long").alias("turn"), c(role).alias("role"), c(text).alias("text"))
    columns = [f.name for f in table.schema.fields if f.name in known]
    record = F.to_json(F.struct(*columns)) if columns else F.lit(None).cast("string")
    found = record_turns(table, record, c(conv_id).cast("long"), layouts)
    return found.select("conv_id", F.posexplode("turns").alias("turn", "t")).select("conv_id", c("turn").cast("long").alias("turn"), "t.role", "t.text")


def escaped(text: Column) -> Column:
    """A text in which no control string is left: ``\\-`` breaks each after its
    first character, and a backslash is doubled. ``unescaped`` undoes it."""
    firsts = "".join(sorted({quoted(x[0]) for x in CONTROL}))
    rests = "|".join(quoted(x[1:]) for x in CONTROL)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"([{firsts}])(?={rests})", r"$1\\-")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:(\\)|-)", "$1")


def formatted(turns: DataFrame) -> DataFrame:
    """For turns (conv_id, turn, role, text), a row for each conversation:
    formatted (its text), and loss, the places (in code points) to learn from:
    turn (from 1), begin (of that turn), start, stop.

    Null roles and texts are empty ones; rows of one turn number are ordered by
    role and text and null numbers come first; repeated rows are turns of their
    own; rows with a null conv_id are one conversation; an empty table gives no
    row. Texts are marked row by row before they meet; what meets in one task is
    one conversation, which has to fit a string (2 GB).
    """
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(START), escaped(c("role")), F.lit(BETWEEN))
    marked = clean.select("conv_id", "turn", "role", "text", head.alias("head"), F.concat(escaped(c("text")), F.lit(END)).alias("rest"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    begin = F.coalesce(F.sum(F.length("head") + F.length("rest")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    placed = marked.withColumns({"n": F.row_number().over(order), "begin": begin})
    start = (c("begin") + F.length("head")).cast("long")
    span = F.when(c("role") == LOSS_ROLE, F.struct(c("n").alias("turn"), "begin", start.alias("start"), (start + F.length("rest") - len(END)).cast("long").alias("stop")))
    pieces = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", F.concat("head", "rest").alias("s")))).alias("pieces"), F.array_sort(F.collect_list(span)).alias("loss"))
    return pieces.select("conv_id", F.array_join(F.transform("pieces", lambda x: x["s"]), "").alias("formatted"), "loss")


def read_back(texts: DataFrame) -> DataFrame:
    """The turns (array of role and text) and the learnt texts of ``formatted`` rows, from their text and mask alone."""
    pieces = F.slice(F.split("formatted", quoted(START)), 2, F.size(F.split("formatted", quoted(START))))
    cut = texts.withColumn("pieces", pieces)
    parts = lambda p: F.split(F.substring(p, F.lit(1), F.length(p) - len(END)), quoted(BETWEEN))
    turn = lambda p: F.transform(F.array(parts(p)), lambda x: F.struct(unescaped(x[0]).alias("role"), unescaped(x[1]).alias("text")))[0]
    learnt = lambda x: unescaped(F.substring(F.get(c("pieces"), x["turn"] - 1), (x["start"] - x["begin"] - len(START) + 1).cast("int"), (x["stop"] - x["start"]).cast("int")))
    return cut.select(*texts.columns, F.transform("pieces", turn).alias("turns"), F.transform("loss", learnt).alias("learnt"))


def digest(texts: DataFrame) -> DataFrame:
    """Counts and digests of ``formatted`` rows as they read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("learnt", "")
    return read_back(texts).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )


#: A conversation that says what other templates use as control strings, as a record of messages.
PROBE_ID, PROBE = -1, '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}'


def with_probe(turns: DataFrame) -> DataFrame:
    """``turns`` and those of the probe record."""
    probe = turns.sparkSession.range(1).select(F.lit(PROBE).alias("record"))
    found = record_turns(probe, c("record"), F.lit(PROBE_ID).cast("long"))
    return turns.unionByName(found.select("conv_id", F.posexplode("turns").alias("turn", "t")).select("conv_id", c("turn").cast("long").alias("turn"), "t.role", "t.text"))


def _sql_escaped(column: str) -> str:
    groups = {}
    for x in CONTROL:
        groups.setdefault(x[0], []).append(quoted(x[1:]))
    out = f"replace({column}, '\\', '\\\\')"
    for first, rests in groups.items():
        out = f"regexp_replace({out}, '({quoted(first)})({'|'.join(rests)})', '\\1\\\\-\\2', 'g')"
    return out


SQL = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
d AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LOSS_ROLE}'), '') AS loss,
  sum({sum(map(len, (START, BETWEEN, END)))} + length({_sql_escaped('role')}) + length({_sql_escaped('text')}))::BIGINT AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM d"""
