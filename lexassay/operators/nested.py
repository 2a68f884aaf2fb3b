"""Deeply nested records as related flat tables.

1. ``merged_schema``: one pass over the raw text finds every path with the kinds of value seen there.
   Partitions dedupe before the exchange; keys that are data (all figures, or one capital letter)
   count as one map key ``*``, so the schema is bounded by the format and not by the number of records.
   (The built-in schema aggregate would make a field of every such key, and nothing of a path whose kind
   differs from record to record.)
2. ``explode_levels``: from that schema an expression is generated that explodes *every* array or map
   level recursively, in one pass over the parsed VARIANT, without a shuffle.  Each row carries the
   record's key, the level it belongs to, its own and its parent's surrogate key, the ordinals of all
   levels above it and its scalar fields, those of objects within it included.
3. ``level_table``: the flat table of one level.

A path is a tuple of steps: ``.name`` for a field of any name, ``[]`` for the items of a list, ``*`` for the
entries of a map.  A surrogate key is the record's key, the level and the ordinals: unique without hashing,
and the parent's key is made of the child's.

A path may hold different kinds from record to record: a scalar, a list and an object at one path give
rows at different levels.  Unreadable or null payloads and empty lists give no rows; null items keep
their ordinal and give a row with a null value.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A format with more paths than this is refused instead of generating an unbounded expression.
MOST_PATHS = 5_000
_KINDS = {dict: "object", list: "array", str: "string", bool: "scalar", int: "scalar", float: "scalar", type(None): "null"}
ITEMS, ENTRIES = "[]", "*"

Path = tuple[str, ...]
Schema = dict[Path, set[str]]


def _is_map(keys: Iterable[str]) -> bool:
    keys = list(keys)
    return bool(keys) and all(k.isdigit() or (len(k) == 1 and "A" <= k <= "Z") for k in keys)


def _paths(value: object, path: Path, out: set[tuple[Path, str]]) -> None:
    out.add((path, _KINDS[type(value)]))
    if isinstance(value, dict):
        star = _is_map(value)
        for k, v in value.items():
            _paths(v, (*path, ENTRIES if star else "." + k), out)
    elif isinstance(value, list):
        for v in value:
            _paths(v, (*path, ITEMS), out)


def render(path: Path) -> str:
    """A path as text: ``query.stems[].options.*``; names that are no identifiers in brackets."""
    first, *rest = path
    return first + "".join(s if s == ITEMS else ".*" if s == ENTRIES else s if s[1:].isidentifier() else f"[{json.dumps(s[1:], ensure_ascii=False)}]" for s in rest)


def merged_schema(records: DataFrame, columns: list[str]) -> Schema:
    """Kinds by path over all records.  ``columns`` are VARIANT columns; a path starts with its column."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[Path, str]] = set()
        for b in batches:
            for name in columns:
                for text in b.column(name).to_pylist():
                    if text is not None:
                        _paths(json.loads(text), (name,), seen)
        pairs = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array([list(p) for p, _ in pairs], pa.list_(pa.string())), pa.array([k for _, k in pairs], pa.string())], ["path", "kind"])

    texts = records.select(*[F.to_json(F.col(c)).alias(c) for c in columns])
    rows = texts.mapInArrow(partial, "path array<string>, kind string").distinct().limit(MOST_PATHS + 1).collect()
    if len(rows) > MOST_PATHS:
        raise ValueError(f"more than {MOST_PATHS} paths: name the keys that are data")
    out: Schema = {}
    for r in rows:
        out.setdefault(tuple(r["path"]), set()).add(r["kind"])
    return out


def _scalar(v: Column) -> Column:
    return F.when(~F.schema_of_variant(v).rlike("^(OBJECT|ARRAY|VOID)"), F.try_variant_get(v, "$", "string"))


def _field(v: Column, names: Iterable[str]) -> Column:
    """The value of nested fields, whatever their names."""
    path = "$"
    for name in names:
        if "'" in name and '"' in name:
            v, path = F.try_element_at(F.try_variant_get(v, path, "map<string,variant>"), F.lit(name)), "$"
        else:
            path += f'["{name}"]' if "'" in name else f"['{name}']"
    return v if path == "$" else F.try_variant_get(v, path, "variant")


_NODE = "array<struct<level:string,parent_level:string,ordinals:array<int>,names:array<string>,value:string,fields:map<string,string>>>"


def levels(schema: Schema) -> list[Path]:
    """The array and map levels of a schema."""
    return sorted(p for p in schema if p[-1] in (ITEMS, ENTRIES))


def scalar_fields(schema: Schema, level: Path) -> list[Path]:
    """Scalar fields of a level, objects within it looked through, as paths below the level."""
    n = len(level)
    return sorted(p[n:] for p, kinds in schema.items() if len(p) > n and p[:n] == level and all(s[0] == "." for s in p[n:]) and kinds & {"string", "scalar"})


def _name(field: Path) -> str:
    return render(("", *field)).removeprefix(".")


def _fields_of(v: Column, fields: list[Path]) -> Column:
    if not fields:
        return F.lit(None).cast("map<string,string>")
    return F.map_from_arrays(F.array(*[F.lit(_name(f)) for f in fields]), F.array(*[_scalar(_field(v, [s[1:] for s in f])) for f in fields]))


def _below(wanted: dict[Path, list[Path]], path: Path) -> bool:
    return any(len(p) >= len(path) and p[: len(path)] == path for p in wanted)


def _nodes(schema: Schema, path: Path, v: Column, names: list[str], parent: Path, ordinals: Column, keys: Column, wanted: dict[Path, list[Path]]) -> list[Column]:
    """Arrays of nodes below the value at ``names`` below ``v``."""
    out = []
    for child in sorted({p[: len(path) + 1] for p in schema if len(p) > len(path) and p[: len(path)] == path and p[len(path)][0] == "."}):
        if _below(wanted, child):
            out += _nodes(schema, child, v, [*names, child[-1][1:]], parent, ordinals, keys, wanted)
    for step in (ITEMS, ENTRIES):
        level = (*path, step)
        if level not in schema or not _below(wanted, level):
            continue

        def one(x: Column, i: Column, key: Column | None = None, level: Path = level) -> Column:
            o = F.concat(ordinals, F.array(i.cast("int")))
            n = F.concat(keys, F.array(key if key is not None else F.lit(None).cast("string")))
            parts = []
            if level in wanted:
                parts.append(F.array(F.struct(F.lit(render(level)).alias("level"), F.lit(render(parent) if parent else "").alias("parent_level"), o.alias("ordinals"), n.alias("names"), _scalar(x).alias("value"), _fields_of(x, wanted[level]).alias("fields"))).cast(_NODE))
            parts += _nodes(schema, level, x, [], level, o, n, wanted)
            return F.concat(*parts) if len(parts) > 1 else parts[0]

        value = _field(v, names)
        if step == ENTRIES:
            children = F.transform(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), lambda e, i: one(e["value"], i, e["key"]))
        else:
            children = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x, i: one(x, i))
        out.append(F.flatten(F.coalesce(children, F.array().cast(f"array<{_NODE}>"))))
    return out


def node_key(key: Column, level: Column | str, ordinals: Column) -> Column:
    """Surrogate key of a node."""
    return F.concat_ws("|", key.cast("string"), F.lit(level) if isinstance(level, str) else level, F.array_join(ordinals, "."))


def explode_levels(records: DataFrame, key: str, columns: list[str], schema: Schema, wanted: dict[Path, list[Path]] | None = None) -> DataFrame:
    """All nodes of all levels: ``key, level, node, parent, ordinals, names, value, fields``.

    The record itself is level ``""`` with the fields of all columns.  ``wanted`` names the levels (``()`` is the
    record) and the fields to make of each; None makes them all.
    """
    if wanted is None:
        wanted = {level: scalar_fields(schema, level) for level in levels(schema)} | {(): [(c, *f) for c in columns for f in scalar_fields(schema, (c,))]}
    parts = []
    none = F.array().cast("array<int>")
    for c in columns:
        if (c,) in schema:
            parts += _nodes(schema, (c,), F.col(c), [], (), none, F.array().cast("array<string>"), wanted)
    own = [f for f in wanted.get((), []) if f in schema]
    if own:
        fields = F.map_from_arrays(F.array(*[F.lit(render(f)) for f in own]), F.array(*[_scalar(_field(F.col(f[0]), [s[1:] for s in f[1:]])) for f in own]))
        parts.append(F.array(F.struct(F.lit("").alias("level"), F.lit(None).cast("string").alias("parent_level"), none.alias("ordinals"), F.array().cast("array<string>").alias("names"), F.lit(None).cast("string").alias("value"), fields.alias("fields"))).cast(_NODE))
    if not parts:
        parts = [F.array().cast(_NODE)]
    rows = records.select(F.col(key), F.explode(F.concat(*parts)).alias("n")).select(key, "n.*")
    up = F.slice("ordinals", F.lit(1), F.greatest(F.size("ordinals") - 1, F.lit(0)))
    return rows.select(key, "level", node_key(F.col(key), F.col("level"), F.col("ordinals")).alias("node"), F.when(F.col("parent_level").isNotNull(), node_key(F.col(key), F.col("parent_level"), up)).alias("parent"), "ordinals", "names", "value", "fields")


def level_table(nodes: DataFrame, key: str, level: str, fields: list[str]) -> DataFrame:
    """The flat table of one level: surrogate keys, ordinal, value and one column per field."""
    return nodes.where(F.col("level") == level).select(key, "node", "parent", F.element_at("ordinals", -1).alias("ordinal"), F.element_at("names", -1).alias("name"), "value", *[F.col("fields")[f].alias(f) for f in fields])


# --- the calls of the service log --------------------------------------------------------------------


def parsed_calls(log: DataFrame) -> DataFrame:
    """``log_id, query, report`` as VARIANT, whatever the payload is wrapped in.

    The request may be wrapped in ``request`` and the answer in ``response``; the query may be the text of
    an object.  The report is that of the question's id, or the only one.
    """
    get = F.try_variant_get
    v = log.select("log_id", F.try_parse_json("payload").alias("v")).where(F.col("v").isNotNull())
    q = F.coalesce(get("v", "$.query", "variant"), get("v", "$.request.query", "variant"))
    v = v.select("log_id", q.alias("q"), get(F.coalesce(get("v", "$.data", "variant"), get("v", "$.response.data", "variant")), "$", "map<string,variant>").alias("d"))
    v = v.select("log_id", "d", F.coalesce(F.when(F.schema_of_variant("q") == "STRING", F.try_parse_json(get("q", "$", "string"))), F.col("q")).alias("query"))
    key = F.coalesce(get("query", "$._id", "double").cast("bigint").cast("string"), get("query", "$._id", "string"))
    report = F.coalesce(F.try_element_at("d", key), F.when(F.size("d") == 1, F.get(F.map_values("d"), F.lit(0))))
    return v.select("log_id", "query", report.alias("report"))


#: Entities of a call: where their levels are, and the field that is their value (None: the node itself).
ENTITIES = {
    "stem": (re.compile(r"query\.stems\[\]"), (".stem",)),
    "option": (re.compile(r"query\.stems\[\]\.options(?:\[\])*\.\*"), None),
    "answer": (re.compile(r"query\.answers(?:\[\])+"), None),
    "error": (re.compile(r"report\[\]\.error_detail\[\]"), (".error_type",)),
}


def call_nodes(log: DataFrame) -> DataFrame:
    """``log_id, entity, level, node, parent, ordinals, names, value`` of the stems, options, answers and errors
    of all calls, at whatever depth the inferred schema has them.  A plain answer is the node of its call."""
    calls = parsed_calls(log)
    schema = merged_schema(calls, ["query", "report"])
    wanted: dict[Path, list[Path]] = {(): [("query", ".answers")]}
    for level in levels(schema):
        for pattern, field in ENTITIES.values():
            if pattern.fullmatch(render(level)):
                wanted[level] = [field] if field else []
    nodes = explode_levels(calls, "log_id", ["query", "report"], schema, wanted)
    entity, value = F.when(F.col("level") == "", "answer"), F.when(F.col("level") == "", F.col("fields")["query.answers"])
    for name, (pattern, field) in ENTITIES.items():
        own = F.col("level").rlike(f"^(?:{pattern.pattern})$")
        entity, value = entity.when(own, name), value.when(own, F.col("fields")[_name(field)] if field else F.col("value"))
    return nodes.select("log_id", entity.alias("entity"), "level", "node", "parent", "ordinals", "names", value.alias("value")).where((F.col("level") != "") | F.col("value").isNotNull())


def call_entities(log: DataFrame) -> DataFrame:
    """``log_id, entity, i, j, value`` of the stems, options, answers and errors of all calls."""
    kind, ordinals = F.col("entity"), F.col("ordinals")
    deeper = F.array_join(F.slice("ordinals", 2, F.greatest(F.size("ordinals") - 1, F.lit(0))), ".")
    j = F.when(kind == "stem", "").when(kind == "option", F.element_at("names", -1)).when(F.size("ordinals") > 1, deeper).otherwise("0")
    value = F.when(kind == "error", F.coalesce("value", F.lit(""))).otherwise(F.col("value"))
    out = call_nodes(log).select("log_id", "entity", F.coalesce(F.get(ordinals, F.lit(0)), F.lit(0)).alias("i"), j.alias("j"), value.alias("value"))
    return out.where(F.col("value").isNotNull() & ~((kind == "stem") & (F.col("value") == "")))


def call_table(log: DataFrame, entity: str) -> DataFrame:
    """The flat table of one entity: ``log_id, node, parent, ordinal, name, value``.

    The parent of an option is the node of its stem, that of an item of an inner list the item above it,
    that of an error its section (``parent`` has no row of its own there), that of the others their call.
    """
    parent = F.when(F.col("entity") == "option", node_key(F.col("log_id"), "query.stems[]", F.slice("ordinals", 1, 1))).otherwise(F.col("parent"))
    nodes = call_nodes(log).where(F.col("entity") == entity)
    return nodes.select("log_id", "node", parent.alias("parent"), F.coalesce(F.try_element_at("ordinals", F.lit(-1)), F.lit(0)).alias("ordinal"), F.try_element_at("names", F.lit(-1)).alias("name"), "value")
