"""Operator 11: chat formatting by schema fingerprints, with DataFrame functions only.

Records come in many layouts: a prompt and its completion, an instruction with input and output, lists of messages. A
record's fingerprint is the hash of the nested field paths that it fills; a declared ``Layout`` names the paths it needs
and may have and how turns are made of them. A lookup of fingerprints selects the layout, so records of all layouts are
converted in one pass. Fields that no layout names play no part. Turns are then written with a ``Template``: control
strings inside texts are broken by a backslash, which reading removes again, and the loss mask is a list of spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, table

#: The value at a path of the record, or of a list's element at a path with ``[]``; NULL where the schema lacks it.
Field = Callable[..., Column]
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """``needs`` and ``may`` are nested field paths (``a.b``, ``a[].b``; ``a[]`` is the list itself); ``turns`` makes the turns of a record."""

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...]
    turns: Callable[[Field], Column]

    def fingerprints(self) -> Iterator[str]:
        for n in range(len(self.may) + 1):
            for more in combinations(self.may, n):
                yield fingerprint_of([*self.needs, *more])


def fingerprint_of(paths: Sequence[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def said(role: Column | str, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def one_by_one(*turns: tuple[str, str]) -> Callable[[Field], Column]:
    """A turn for each (role, field) that the record has; the last one always."""

    def make(field: Field) -> Column:
        parts = [F.when(F.lit(i == len(turns) - 1) | field(f).isNotNull(), said(role, field(f))) for i, (role, f) in enumerate(turns)]
        return F.filter(F.array(*parts), lambda t: t.isNotNull())

    return make


def listed(container: str, role: str, text: str, names: dict[str, str] | None = None) -> Callable[[Field], Column]:
    """A turn for each element of a list; ``names`` renames roles. Missing elements are turns without role and text."""

    def make(field: Field) -> Column:
        def turn(x: Column) -> Column:
            told = r = field(f"{container}[].{role}", x)
            for old, new in (names or {}).items():
                r = F.when(told == old, F.lit(new)).otherwise(r)
            return said(r, field(f"{container}[].{text}", x))

        return F.transform(field(container), turn)

    return make


#: Roles of the layout that calls them by other names.
ALIASES = {"human": "user", "gpt": "assistant"}

LAYOUTS: tuple[Layout, ...] = (
    Layout("prompt", ("completion",), ("prompt", "system"), one_by_one(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("response", ("response",), ("prompt", "system"), one_by_one(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("question", ("answer",), ("question",), one_by_one(("user", "question"), ("assistant", "answer"))),
    Layout("instruction", ("instruction", "output"), ("input",), one_by_one(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("messages", ("messages[]",), ("messages[].role", "messages[].content"), listed("messages", "role", "content")),
    Layout("conversations", ("conversations[]",), ("conversations[].from", "conversations[].value"), listed("conversations", "from", "value", ALIASES)),
)

#: All fields of the layouts above, as JSON records have them.
RECORD = "prompt string, completion string, response string, system string, question string, answer string, instruction string, input string, output string, messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>"


@dataclass(frozen=True)
class Template:
    """Marks of a turn: ``<open>role<says>text<close>``. ``controls`` are strings that texts must not hold unescaped, the marks among them.

    Each control string begins with ``<`` or ``[`` and has neither after that, so no two of them overlap.
    """

    open: str = "<|turn|>"
    says: str = "<|says|>"
    close: str = "<|end|>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>")

    def pattern(self) -> tuple[str, str]:
        """First characters and rests, as regular expressions."""
        every = dict.fromkeys([self.open, self.says, self.close, *self.controls])
        return r"([<\[])", "(" + "|".join(re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", c[1:]) for c in every) + ")"

    def escaped(self, text: Column) -> Column:
        """One backslash more between the first character of a control string and its rest: none has none any longer."""
        first, rest = self.pattern()
        return F.regexp_replace(text, first + r"(\\*)" + rest, r"$1\\$2$3")

    def plain(self, text: Column) -> Column:
        first, rest = self.pattern()
        return F.regexp_replace(text, first + r"\\(\\*)" + rest, "$1$2$3")


def some_have(items: Column, name: str) -> Column:
    return F.coalesce(F.exists(items, lambda x: x[name].isNotNull()), F.lit(False))


def present_paths(schema: T.StructType, at: Column, prefix: str = "") -> list[tuple[str, Column]]:
    """Each nested field path of ``schema`` and whether the record ``at`` fills it."""
    out: list[tuple[str, Column]] = []
    for f in schema.fields:
        path, value = prefix + f.name, at[f.name]
        if isinstance(f.dataType, T.StructType):
            out += present_paths(f.dataType, value, path + ".")
        elif isinstance(f.dataType, T.ArrayType):
            out.append((path + "[]", value.isNotNull()))
            if isinstance(f.dataType.elementType, T.StructType):
                # fields of list elements; deeper lists count as one field
                out += [(f"{path}[].{g}", some_have(value, g)) for g in f.dataType.elementType.names]
        else:
            out.append((path, value.isNotNull()))
    return out


def canonical_turns(records: DataFrame, id_col: str, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """id, fingerprint, layout, turns (role, text) of each record.

    The record's fields are all columns but ``id_col``. Missing roles and texts are empty. A record that fits no layout
    stays, with a NULL layout and NULL turns; one with an empty list has no turns. Repeated rows stay, an empty table
    gives no rows.
    """
    fields = [c for c in records.columns if c != id_col]
    known = {p for x in layouts for p in (*x.needs, *x.may)}
    nested = T.StructType([f for f in records.schema.fields if f.name != id_col])
    every = records.select(F.col(f"`{id_col}`").alias("id"), F.struct(*[F.col(f"`{c}`") for c in fields]).alias("rec") if fields else F.lit(None).alias("rec"))
    paths = [(p, there) for p, there in present_paths(nested, F.col("rec")) if p in known]
    there = F.array(*[F.when(is_there, F.lit(p)) for p, is_there in sorted(paths, key=lambda x: x[0])]).cast("array<string>")
    x = every.withColumn("fingerprint", F.sha2(F.array_join(F.array_compact(there), "\n"), 256))
    have = {p for p, _ in paths}

    def field(path: str, element: Column | None = None) -> Column:
        if path not in have and path + "[]" not in have:
            return F.lit(None).cast("string")
        if element is not None:
            return element[path.split("[].")[1]]
        at = F.col("rec")
        for name in path.split("."):
            at = at[name]
        return at

    usable = [y for y in layouts if have.issuperset(y.needs)]
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for y in usable:
        name = F.when(F.col("fingerprint").isin(*y.fingerprints()), F.lit(y.name)).otherwise(name)
    for y in usable:
        turns = F.when(F.col("layout") == y.name, y.turns(field).cast(TURNS)).otherwise(turns)
    return x.withColumn("layout", name).select(F.col("id").alias(id_col), "fingerprint", "layout", turns.alias("turns"))


def json_records(texts: DataFrame, id_col: str, json_col: str, record: str = RECORD) -> DataFrame:
    """Records of JSON text; text that isn't JSON gives a record without any field."""
    return texts.select(id_col, F.from_json(json_col, record).alias("_r")).select(id_col, "_r.*")


def formatted(chats: DataFrame, id_col: str, template: Template = Template(), learn: str = "assistant") -> DataFrame:
    """id, layout, formatted, loss_mask of canonical turns.

    The mask has an entry for each turn: ``skip`` characters from its opening mark on aren't learned, the ``take`` after
    them are, the rest of the turn isn't. Learned are the escaped texts of the role ``learn``. NULL turns give a NULL text
    and mask, no turns an empty text. Entries are relative to their turn, so that no running sum makes them quadratic.
    """

    def written(t: Column) -> Column:
        return F.concat(F.lit(template.open), template.escaped(t["role"]), F.lit(template.says), template.escaped(t["text"]), F.lit(template.close))

    def mask(t: Column) -> Column:
        skip = F.length(template.escaped(t["role"])) + len(template.open) + len(template.says)
        take = F.when(t["role"] == learn, F.length(template.escaped(t["text"]))).otherwise(0)
        return F.struct(skip.alias("skip"), take.alias("take"))

    return chats.select(id_col, "layout", F.array_join(F.transform("turns", written), "").alias("formatted"), F.transform("turns", mask).alias("loss_mask"))


def read_back(written: DataFrame, id_col: str, template: Template = Template()) -> DataFrame:
    """id, turns, loss_text (all text under the mask, in order), formatted_chars: what ``formatted`` wrote, unescaped."""
    # texts hold no unescaped mark, so the opening mark cuts turns only; ahead of the first there is nothing
    pieces = F.slice(F.split("formatted", re.sub(r"(\W)", r"\\\1", template.open)), 2, 2**30)

    def turn(p: Column) -> Column:
        role = F.substring_index(p, template.says, 1)
        begin = F.length(role) + len(template.says) + 1
        text = F.substring(p, begin, F.length(p) - begin + 1 - len(template.close))
        return F.struct(template.plain(role).alias("role"), template.plain(text).alias("text"))

    def learned(p: Column, m: Column) -> Column:
        return template.plain(F.substring(p, m["skip"] - len(template.open) + 1, m["take"]))

    loss = F.array_join(F.zip_with(pieces, "loss_mask", learned), "")
    return written.select(id_col, F.transform(pieces, turn).alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def from_turn_rows(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One record a conversation, in the layout that its turns allow, from one row a turn.

    Rows are in order of turn (NULLs first), then role and text. A user's and an assistant's turn are a prompt and its
    completion; a system's turn before those makes them an instruction with input and output; other conversations are
    lists of messages, and of these the ones with odd ids that know only the three roles are in the layout with other
    names. Missing roles and texts are empty; rows without an id are one conversation.
    """
    row = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    chats = rows.select(F.col(id_col).cast("long").alias("id"), row.alias("row")).groupBy("id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    roles = F.transform("rows", lambda t: t["role"])
    text = lambda i: F.col("rows")[i]["text"]
    of = lambda *names: roles == F.array(*[F.lit(n) for n in names])
    pair, triple = of("user", "assistant"), of("system", "user", "assistant")
    named = (F.pmod("id", F.lit(2)) == 1) & F.forall(roles, lambda r: r.isin("system", "user", "assistant"))
    alias = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    kind = F.when(pair, "prompt").when(triple, "instruction").when(named, "conversations").otherwise("messages")
    x = chats.withColumn("kind", kind)
    only = lambda name, value: F.when(F.col("kind") == name, value)
    return x.select(
        F.col("id").alias(id_col),
        only("prompt", text(0)).alias("prompt"),
        only("prompt", text(1)).alias("completion"),
        only("instruction", text(0)).alias("instruction"),
        only("instruction", text(1)).alias("input"),
        only("instruction", text(2)).alias("output"),
        only("messages", F.transform("rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))).alias("messages"),
        only("conversations", F.transform("rows", lambda t: F.struct(alias(t["role"]).alias("from"), t["text"].alias("value")))).alias("conversations"),
    )


def digests(written: DataFrame, id_col: str = "conv_id", template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from formatted conversations."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(written, id_col, template).select(
        id_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: The conversation that ``op11_chat_format`` adds: id, and the text of both turns.
ADDED, ADDED_TEXT = -7, "</s>[INST] ok [/INST]"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and one with control strings in its texts: formatted, written, read back."""
    added = spark.sql(f"select {ADDED}L as conv_id, x.turn, x.role, '{ADDED_TEXT}' as text from (select explode(array(struct(0L as turn, 'user' as role), struct(1L as turn, 'assistant' as role))) as x)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    chats = canonical_turns(from_turn_rows(rows), "conv_id")
    return digests(materialize(formatted(chats, "conv_id"), "chats"), "conv_id")


def _sql() -> str:
    """The same by plain SQL over the rows: no layouts, no reading back; formatted_chars adds up the template's parts."""
    t = Template()
    first, rest = t.pattern()
    marks = len(t.open) + len(t.says) + len(t.close)

    def size(column: str) -> str:
        return f"length(regexp_replace({column}, '{first}(\\\\*){rest}', '\\1\\\\\\2\\3', 'g'))"

    return f"""with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select {ADDED}, 0, 'user', '{ADDED_TEXT}' union all select {ADDED}, 1, 'assistant', '{ADDED_TEXT}')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum({marks} + {size("role")} + {size("text")}) as bigint) as formatted_chars
from r group by conv_id"""


OP11_SQL = _sql()
