"""Chat formatting, in DataFrame operations only.

Records come in many layouts. A record's fingerprint is the hash of its nested field paths; it selects a declarative
mapping that turns the record into canonical turns (role, content). Turns are rendered with a template whose control
strings cannot occur inside a text, since ``\\`` and ``<`` are escaped there (and ``>`` in a role), reversibly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Layout:
    """``paths``: the record's schema with every scalar written as ``v``, fields in alphabetical order. ``turns``: pairs
    of a role (a path if it begins with ``$``, else itself) and the paths of the content, joined by blank lines, taken
    from the record or from each element of ``each``; a path ``$.content[].text`` joins that field of a list of parts by line
    ends. ``order``: the path of a turn's number where a record is one turn."""

    paths: str
    turns: tuple
    each: str = ""
    key: str = "$.id"
    order: str = ""


LAYOUTS = {
    "turn rows": Layout("OBJECT<conv_id: v, role: v, text: v, turn: v>", (("$.role", ("$.text",)),), key="$.conv_id", order="$.turn"),
    "messages": Layout("OBJECT<id: v, messages: ARRAY<OBJECT<content: v, role: v>>>", (("$.role", ("$.content",)),), each="$.messages"),
    "messages of parts": Layout("OBJECT<id: v, messages: ARRAY<OBJECT<content: ARRAY<OBJECT<text: v, type: v>>, role: v>>>", (("$.role", ("$.content[].text",)),), each="$.messages"),
    "from and value": Layout("OBJECT<conversations: ARRAY<OBJECT<from: v, value: v>>, id: v>", (("$.from", ("$.value",)),), each="$.conversations"),
    "prompt and response": Layout("OBJECT<id: v, prompt: v, response: v>", (("user", ("$.prompt",)), ("assistant", ("$.response",)))),
    "prompt and completion": Layout("OBJECT<completion: v, id: v, prompt: v>", (("user", ("$.prompt",)), ("assistant", ("$.completion",)))),
    "instruction": Layout("OBJECT<id: v, instruction: v, output: v>", (("user", ("$.instruction",)), ("assistant", ("$.output",)))),
    "instruction with input": Layout("OBJECT<id: v, input: v, instruction: v, output: v>", (("user", ("$.instruction", "$.input")), ("assistant", ("$.output",)))),
    "instruction with system": Layout("OBJECT<id: v, instruction: v, output: v, system: v>", (("system", ("$.system",)), ("user", ("$.instruction",)), ("assistant", ("$.output",)))),
}
#: Names that layouts use for the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
_SCALAR = r"(?<=: |ARRAY<)(BIGINT|STRING|VOID|DOUBLE|FLOAT|BOOLEAN|DECIMAL\([0-9,]+\)|DATE|TIMESTAMP_NTZ|TIMESTAMP|BINARY)(?=[,>])"
_TURNS = "array<struct<role:string,content:string>>"


def field_paths(record: Column, layouts: dict[str, Layout] = LAYOUTS) -> Column:
    """The nested field paths of a variant, without scalar fields of a name that no layout has (``source``, ``score``)."""
    names = sorted({n for layout in layouts.values() for n in re.findall(r"(\w+): ", layout.paths)})
    paths = F.regexp_replace(F.schema_of_variant(record), _SCALAR, "v")
    extra = rf"(?<=<|, )(?!(?:{'|'.join(names)}): )(?:`(?:[^`]|``)*`|[^\s<>,:`]+): v(?:, |(?=>))"
    return F.regexp_replace(F.regexp_replace(paths, extra, ""), ", >", ">")


def fingerprint(record: Column, layouts: dict[str, Layout] = LAYOUTS) -> Column:
    """The hash of the nested field paths of a variant."""
    return F.xxhash64(field_paths(record, layouts))


def _turns(layout: Layout, record: Column) -> Column:

    def text(v: Column, path: str) -> Column:
        if "[]." not in path:
            return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))
        whole, field = path.split("[].")
        parts = F.transform(F.try_variant_get(v, whole, "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, f"$.{field}", "string"), F.lit("")))
        return F.coalesce(F.array_join(parts, "\n"), F.lit(""))

    def made(v: Column) -> Column:
        named = [(text(v, role) if role[0] == "$" else F.lit(role), F.array_join(F.filter(F.array(*[text(v, p) for p in paths]), lambda x: x != "") if len(paths) > 1 else F.array(text(v, paths[0])), "\n\n")) for role, paths in layout.turns]
        return F.array(*[F.struct(role.alias("role"), content.alias("content")) for role, content in named])

    if not layout.each:
        return made(record)
    return F.flatten(F.transform(F.try_variant_get(record, layout.each, "array<variant>"), made))


def canonical_turns(records: DataFrame, record: str = "record", *, layouts: dict[str, Layout] = LAYOUTS) -> DataFrame:
    """(key, turn, role, content, layout, record_no): the turns of all records, a variant column each.

    Scalar fields beside those of a layout don't matter, unless another layout knows their names. Records of several turns are
    conversations of their own, told apart by ``record_no`` where they share an id; rows of one turn have 0 there.
    A record whose fingerprint no layout has gives one row with null turn, role, content and layout. It, and a record of
    several turns without an id of its own, gets a key made of ``#``, a hash of its content and its row number, so records
    that are not known never become one conversation. Rows of one turn each belong together by their key, so those with a
    null key are one conversation. Null fields count as fields; null contents are empty. Roles known by another name get the
    canonical one. An empty table gives an empty result; columns beside ``record`` are left out.
    """
    v, own = F.col(record), F.col("_own")
    name, turns, key, order = (F.lit(None).cast(t) for t in ("string", _TURNS, "string", "long"))
    single = F.lit(False)
    for label, layout in layouts.items():
        is_it = own == F.xxhash64(F.lit(layout.paths))
        name = F.when(is_it, label).otherwise(name)
        turns = F.when(is_it, _turns(layout, v)).otherwise(turns)
        key = F.when(is_it, F.try_variant_get(v, layout.key, "string")).otherwise(key)
        if layout.order:
            order = F.when(is_it, F.try_variant_get(v, layout.order, "long")).otherwise(order)
            single = single | is_it
    known_key = F.coalesce(key, F.when(order.isNull(), F.concat(F.lit("#"), F.hex(F.xxhash64(F.to_json(v))), F.lit("-"), F.col("_number").cast("string"))))
    found = records.select(v.alias(record)).withColumns({"_own": fingerprint(v, layouts), "_number": F.monotonically_increasing_id()}).select(known_key.alias("key"), order.alias("_order"), name.alias("layout"), F.when(single, F.lit(0)).otherwise(F.col("_number")).alias("record_no"), F.posexplode_outer(turns).alias("_i", "_t"))
    role = F.col("_t.role")
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return found.select("key", F.coalesce("_order", F.col("_i").cast("long")).alias("turn"), F.coalesce(F.get(F.array(known[role]), F.lit(0)), role).alias("role"), F.col("_t.content").alias("content"), "layout", "record_no")


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit(">"), F.lit("\\g")) if role else out


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\e"), F.lit("\\"))


_CLOSE = "</turn>\n"


def format_chats(turns: DataFrame, *, key: str = "key", order: str = "turn", learn: str = "assistant", record: str = "record_no") -> DataFrame:
    """(key, formatted, loss_spans) for each conversation of canonical turns: those of one key and, if the table has that
    column, of one ``record``.

    ``loss_spans``: character ranges (end excluded) of the texts of role ``learn`` in ``formatted``. Turns stand in the
    order of ``order``, then role and content; repeated rows are repeated turns. A conversation is one string, so its
    own text must fit a task. Null role or content: empty. A null key is a conversation of its own.
    """
    role, content = (F.coalesce(c, F.lit("")) for c in ("role", "content"))
    head = F.concat(F.lit("<turn "), escaped(role, True), F.lit(">"))
    number = F.col(record) if record in turns.columns else F.lit(0)
    rows = turns.select(key, number.alias("_record"), F.col(order).alias("_o"), role.alias("role"), content.alias("content"), F.concat(head, escaped(content), F.lit(_CLOSE)).alias("_shown"), F.length(head).alias("_head"))
    upto = F.sum(F.length("_shown").cast("long")).over(Window.partitionBy(key, "_record").orderBy("_o", "role", "content").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_end", upto)
    span = F.struct((F.col("_end") - F.length("_shown") + F.col("_head")).alias("start"), (F.col("_end") - len(_CLOSE)).alias("end"))
    shown = F.array_sort(F.collect_list(F.struct("_end", "_shown")))
    spans = F.array_sort(F.collect_list(F.when(F.col("role") == learn, span)))
    return rows.groupBy(key, "_record").agg(F.array_join(F.transform(shown, lambda x: x["_shown"]), "").alias("formatted"), spans.alias("loss_spans")).drop("_record")


def read_chats(chats: DataFrame) -> DataFrame:
    """``chats`` with ``turns`` (role, content) read back from ``formatted``, and ``loss_texts`` from the masked ranges."""
    pieces = F.split("formatted", _CLOSE)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    close = lambda x: F.instr(x, ">")
    parse = lambda x: F.struct(unescaped(F.substring(x, F.lit(7), close(x) - 7)).alias("role"), unescaped(F.substring(x, close(x) + 1, F.length(x))).alias("content"))
    masked = F.transform("loss_spans", lambda s: unescaped(F.substring("formatted", (s.start + 1).cast("int"), (s.end - s.start).cast("int"))))
    return chats.withColumn("turns", F.transform(pieces, parse)).withColumn("loss_texts", masked)
