"""Scan an artifact corpus and extract its definitions as one table of discovered items.

Every definition file is one row, so all work on it is row-local: sections become arrays, arrays are laid end to
end in discovery order, and a position in that array is the evidence number. Nothing is shuffled, and a broken
file yields an ``error`` item instead of failing the corpus.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewell.functions.text import qualified_name, sql_tables, strip_space
from tracewell.operators.keyed import ordinal

# Suffix -> format, document kinds, defaults, classification names.
FORMATS = {".ktr": "ktr", ".kjb": "kjb", ".hpl": "hop", ".hwf": "hop", ".xml": "hop", ".json": "json"}
PUBLIC_FORMAT = {"ktr": "pentaho-xml", "kjb": "pentaho-xml", "hop": "xml", "json": "json"}
STRUCTURAL = "structural"
FROM_SQL = "inferred-deterministic-sql-reference"
PIPELINE_ENTRY_TYPES = ["TRANS", "JOB", "PIPELINE", "WORKFLOW"]
ITEM_FIELDS = {
    "kind": "string", "locator": "string", "value": "string", "step_id": "string", "name": "string",
    "type": "string", "description": "string", "connection": "string", "schema_name": "string",
    "table_name": "string", "target_name": "string", "data_type": "string", "expression": "string",
    "default_value": "string", "scope": "string", "from_name": "string", "to_name": "string",
    "enabled": "boolean", "role": "string", "classification": "string", "is_table": "boolean",
    "is_endpoint": "boolean", "config": "map<string,string>", "source_sha256": "string",
}



def _repeatable(schema: str) -> str:
    """The schema with every text leaf as an array, since an element may occur again; the first one counts."""
    return re.sub(r": STRING\b", ": ARRAY<STRING>", schema)


_HOPS = "ARRAY<STRUCT<hop: ARRAY<STRUCT<`from`: STRING, `to`: STRING, enabled: STRING>>>>"
_PARAMETERS = "ARRAY<STRUCT<parameter: ARRAY<STRUCT<name: STRING, default_value: STRING, `default`: STRING, description: STRING>>>>"
_INFO = f"info STRUCT<name: STRING, parameters: {_PARAMETERS}>"
HOP_SCHEMA = _repeatable(
    f"{_INFO}, transform ARRAY<STRUCT<name: STRING, type: STRING, description: STRING, connection: STRING, "
    "`schema`: STRING, `table`: STRING, sql: STRING, fields: ARRAY<STRUCT<field: ARRAY<STRUCT<name: STRING, "
    f"stream_name: STRING, column_name: STRING, type: STRING>>>>>>, `order` {_HOPS}, _bad STRING"
)
_KTR_FIELDS = (
    "ARRAY<STRUCT<field: ARRAY<STRUCT<name: STRING, field_name: STRING, rename: STRING, column_name: STRING, "
    "type: STRING, calculation: STRING, formula: STRING>>>>"
)
KTR_SCHEMA = _repeatable(
    f"{_INFO}, parameters {_PARAMETERS}, connection ARRAY<STRUCT<name: STRING, type: STRING, server: STRING, "
    "database: STRING, port: STRING>>, step ARRAY<STRUCT<name: STRING, type: STRING, description: STRING, "
    f"connection: STRING, `schema`: STRING, `table`: STRING, lookup: STRUCT<`table`: STRING, fields: {_KTR_FIELDS}>, "
    f"sql: STRING, fields: {_KTR_FIELDS}>>, `order` {_HOPS}, _bad STRING"
)
KJB_SCHEMA = _repeatable(
    f"name ARRAY<STRING>, {_INFO}, parameters {_PARAMETERS}, entries ARRAY<STRUCT<entry: ARRAY<STRUCT<name: STRING, "
    "type: STRING, description: STRING, filename: STRING, transname: STRING, jobname: STRING>>>>, "
    f"hops {_HOPS}, `order` {_HOPS}, _bad STRING"
)
JSON_SCHEMA = (
    "pipeline STRUCT<name: STRING, description: STRING>, connections ARRAY<VARIANT>, steps ARRAY<STRUCT<id: STRING, "
    "name: STRING, type: STRING, description: STRING, connection: STRING, `schema`: STRING, `table`: STRING, "
    "role: STRING, sql: VARIANT, fields: ARRAY<VARIANT>>>, hops ARRAY<STRUCT<`from`: STRING, `to`: STRING, enabled: VARIANT>>"
)
_VARIABLES = _repeatable("variables ARRAY<STRUCT<variable: ARRAY<STRUCT<name: STRING, value: STRING, scope: STRING>>>>")
_XML = {"columnNameOfCorruptRecord": "_bad", "ignoreSurroundingSpaces": "false"}


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Definition files under ``path`` with format, text and digest of the raw bytes.

    Spark leaves files of zero bytes out of a scan, so those do not show up as errors.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return route_artifacts(
        files.select("path", F.col("content").cast("string").alias("content"), F.sha2("content", 256).alias("source_sha256"))
    )


def route_artifacts(files: DataFrame) -> DataFrame:
    """Choose the format by lower-cased suffix; anything else is an error."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(name, r".(\.[^.]+)$", 1))
    fmt = reduce(lambda acc, kv: F.when(suffix == kv[0], F.lit(kv[1])).otherwise(acc), FORMATS.items(), F.lit(None))
    return files.select(
        F.col("path").alias("artifact_id"),
        "path",
        F.regexp_replace(name, r"(?<=.)\.[^.]+$", "").alias("stem"),
        fmt.cast("string").alias("fmt"),
        "content",
        "source_sha256",
        F.when(fmt.isNull(), F.concat(F.lit("unsupported ETL artifact: "), "path")).alias("error"),
    )


def classify_role(step_type: Column, fmt: Column, explicit: Column | None = None) -> Column:
    """Role of a step's table from its type; the order in which words are tried differs by format."""
    low = F.lower(step_type)

    def first(*words: tuple[str, tuple[str, ...]]) -> Column:
        picked = F.lit("referenced")
        for role, hints in reversed(words):
            picked = F.when(reduce(Column.__or__, [low.contains(h) for h in hints]), F.lit(role)).otherwise(picked)
        return picked

    hop = first(("source", ("input",)), ("target", ("output",)))
    pentaho = first(("target", ("output", "writer")), ("source", ("input", "reader")))
    guessed = first(("source", ("input", "source", "read")), ("target", ("output", "target", "write")))
    named = F.lower(explicit) if explicit is not None else F.lit(None).cast("string")
    legacy = F.when(named.isin("source", "target", "referenced"), named).otherwise(guessed)
    return F.when(fmt == "hop", hop).when(fmt == "json", legacy).otherwise(pentaho)


def _text(value: Column, default: Column | str = "") -> Column:
    """Stripped text of the first such element; the default stands for an absent element, not for an empty one."""
    return F.coalesce(strip_space(F.get(value, F.lit(0))), F.lit(default) if isinstance(default, str) else default)


def _filled(*values: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def _array(array: Column) -> Column:
    return F.coalesce(array, F.array())


def _inner(outer: Column, name: str) -> Column:
    """Elements of a section that may itself occur several times."""
    return F.flatten(F.transform(_array(outer), lambda s: F.coalesce(s[name], F.array())))


def _each(array: Column, build) -> Column:
    """Values built from each element and its position from one; elements that give null are left out."""
    return F.array_compact(F.transform(_array(array), lambda x, i: build(x, i + 1)))


def _leaves(nodes: Column, leaf) -> Column:
    """Cleaned leaves of each element. Lambdas share no subexpressions, so what is read more than once is computed here."""
    return F.transform(_array(nodes), lambda x: F.struct(*[c.alias(n) for n, c in leaf(x).items()]))


def _loc(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@lru_cache(maxsize=None)
def _absent(_app: str, name: str, dtype: str) -> Column:
    return F.lit(None).cast(dtype).alias(name)


def _record(types: dict[str, str], values: dict[str, Column]) -> Column:
    app = SparkContext.getOrCreate().applicationId
    return F.struct(*[values[n].alias(n) if n in values else _absent(app, n, t) for n, t in types.items()])


@lru_cache(maxsize=None)
def _expressions(_app: str) -> dict[str, Column]:
    """The document and item columns; they name columns only, so one set serves every corpus of a session."""
    docs = {"hop": _hop_doc, "ktr": _ktr_doc, "kjb": _kjb_doc, "json": _json_doc}
    return {**{f: build(F.col(f"_{f}")) for f, build in docs.items()}, "items": _items()}


# One shape for all formats: each leaf is cleaned once here, and items are built from the cleaned leaves.
NAMED_FIELDS = {"at": "int", "name": "string", "type": "string", "value": "string", "note": "string", "config": "map<string,string>"}
FIELD_FIELDS = {"at": "int", "name": "string", "target_name": "string", "data_type": "string", "expression": "string"}
STEP_FIELDS = {
    "step_id": "string", "name": "string", "type": "string", "description": "string", "connection": "string",
    "schema_name": "string", "table_name": "string", "qualified": "string", "role": "string", "sql": "string",
    "refs": "array<string>", "calls": "string",
    "fields": "array<struct<at: int, name: string, target_name: string, data_type: string, expression: string>>",
}
HOP_FIELDS = {"from_name": "string", "to_name": "string", "enabled": "boolean"}


def _named(nodes: Column, leaf) -> Column:
    """Records of the elements that have a name, with their position among all elements."""
    names: list[str] = []

    def noted(x):
        found = leaf(x)
        names[:] = found
        return found

    def one(x, i):
        return F.when(x["name"] != "", _record(NAMED_FIELDS, {"at": i, **{n: x[n] for n in names}}))

    return _each(_leaves(nodes, noted), one)


def _parameter(p: Column) -> dict[str, Column]:
    default = F.coalesce(_filled(_text(p["default_value"])), _text(p["default"]))
    return {"name": _text(p["name"]), "value": default, "note": _text(p["description"])}


def _variable(v: Column) -> dict[str, Column]:
    return {"name": _text(v["name"]), "value": _text(v["value"]), "note": _text(v["scope"], "artifact")}


def _hop(h: Column, _i) -> Column:
    on = F.upper(_text(h["enabled"], "Y")) != "N"
    return _record(HOP_FIELDS, {"from_name": _text(h["from"]), "to_name": _text(h["to"]), "enabled": on})


def _fields(nodes: Column, build) -> Column:
    def one(f, j):
        values = build(f)
        return F.when(values["name"].isNotNull(), _record(FIELD_FIELDS, {"at": j, **values}))

    return _each(nodes, one)


def _texts(node: Column, *names: str) -> dict[str, Column]:
    return {n: _text(node[n]) for n in names}


def _doc(**sections: Column) -> Column:
    none = F.array()
    kinds = {"connections": NAMED_FIELDS, "parameters": NAMED_FIELDS, "steps": STEP_FIELDS, "hops": HOP_FIELDS}

    def typed(fields):
        return "array<struct<" + ", ".join(f"{n}: {t}" for n, t in fields.items()) + ">>"

    return F.struct(*[sections.get(n, none).cast(typed(t)).alias(n) for n, t in kinds.items()])


def _xml_leaves(t: Column) -> dict[str, Column]:
    """Leaves of a step that both XML formats have; the name is null where there is none, as its default goes by place."""
    return {
        "name": strip_space(F.get(t["name"], F.lit(0))), "type": _text(t["type"], "unknown"), "description": _text(t["description"]),
        **{n: _filled(c) for n, c in _texts(t, "connection", "schema", "sql").items()}, "fields": t["fields"],
    }


def _xml_step(t: Column, sid: Column, default_name: Column, fmt: str, **more: Column) -> Column:
    table = t["table"]
    values = {
        "step_id": sid, "name": F.coalesce(t["name"], default_name), "type": t["type"], "description": t["description"],
        "connection": t["connection"], "schema_name": t["schema"], "table_name": table,
        "qualified": F.when(table.isNotNull(), qualified_name(t["schema"], table)),
        "role": F.when(table.isNotNull(), classify_role(t["type"], F.lit(fmt))),
        "sql": t["sql"], **more,
    }
    return _record(STEP_FIELDS, values)


def _hop_doc(p: Column) -> Column:
    def field(f):
        return {
            "name": _filled(f["name"], f["stream_name"], f["column_name"]), "target_name": _filled(f["column_name"]),
            "data_type": _filled(f["type"]),
        }

    def parts(f):
        return _texts(f, "name", "stream_name", "column_name", "type")

    def leaves(t):
        return {**_xml_leaves(t), "table": _filled(_text(t["table"]))}

    def step(t, i):
        fields = _fields(_leaves(_inner(t["fields"], "field"), parts), field)
        return _xml_step(t, ordinal("step", i), _loc("step-", i), "hop", fields=fields)

    return _doc(
        parameters=_named(_inner(p["info"]["parameters"], "parameter"), _parameter),
        steps=_each(_leaves(p["transform"], leaves), step),
        hops=_each(_inner(p["order"], "hop"), _hop),
    )


def _ktr_doc(p: Column) -> Column:
    def connection(c):
        config = F.create_map(*[x for k in ("server", "database", "port") for x in (F.lit(k), _text(c[k]))])
        return {"name": _text(c["name"]), "type": _text(c["type"], "database"), "config": config}

    def parts(f):
        return _texts(f, "name", "field_name", "rename", "column_name", "type", "calculation", "formula")

    def field(f):
        return {
            "name": _filled(f["name"], f["field_name"]), "target_name": _filled(f["rename"], f["column_name"]),
            "data_type": _filled(f["type"]), "expression": _filled(f["calculation"], f["formula"]),
        }

    def leaves(t):
        table = _filled(_text(t["table"]), _text(t["lookup"]["table"]))
        refs = _array(sql_tables(F.get(t["sql"], F.lit(0))))
        return {**_xml_leaves(t), "table": table, "lookup_fields": t["lookup"]["fields"], "refs": refs}

    def step(t, i):
        sid = ordinal("step", i)
        both = F.concat(_inner(t["fields"], "field"), _inner(t["lookup_fields"], "field"))
        fields = _fields(_leaves(both, parts), field)
        return _xml_step(t, sid, sid, "ktr", refs=t["refs"], fields=fields)

    both = F.concat(_inner(p["info"]["parameters"], "parameter"), _inner(p["parameters"], "parameter"))
    return _doc(
        connections=_named(p["connection"], connection),
        parameters=_named(both, _parameter),
        steps=_each(_leaves(p["step"], leaves), step),
        hops=_each(_inner(p["order"], "hop"), _hop),
    )


def _kjb_doc(p: Column) -> Column:
    def leaves(e):
        return {
            "name": strip_space(F.get(e["name"], F.lit(0))), "type": _text(e["type"], "unknown"),
            **_texts(e, "description", "filename", "transname", "jobname"),
        }

    def entry(e, i):
        sid = ordinal("step", i)
        file = _filled(e["filename"], e["transname"], e["jobname"])
        values = {
            "step_id": sid, "name": F.coalesce(e["name"], sid), "type": e["type"], "description": e["description"],
            "calls": F.when(F.upper(e["type"]).isin(PIPELINE_ENTRY_TYPES), file),
        }
        return _record(STEP_FIELDS, values)

    both = F.concat(_inner(p["info"]["parameters"], "parameter"), _inner(p["parameters"], "parameter"))
    return _doc(
        parameters=_named(both, _parameter),
        steps=_each(_leaves(_inner(p["entries"], "entry"), leaves), entry),
        hops=_each(F.concat(_inner(p["hops"], "hop"), _inner(p["order"], "hop")), _hop),
    )


def _json_doc(p: Column) -> Column:
    def got(v, path):
        return F.try_variant_get(v, path, "string")

    def connection(c, i):
        rest = F.map_filter(F.try_variant_get(c, "$", "map<string,string>"), lambda k, _: ~k.isin("name", "type"))
        values = {
            "at": i, "name": F.coalesce(_filled(got(c, "$.name")), _loc("connection-", i)),
            "type": F.coalesce(_filled(got(c, "$.type")), F.lit("unknown")), "config": rest,
        }
        return _record(NAMED_FIELDS, values)

    def parts(f):
        return {"given": f, "plain": F.schema_of_variant(f) == "STRING"}

    def field(x):
        f, plain = x["given"], x["plain"]
        return {
            "name": _filled(F.when(plain, got(f, "$")).otherwise(got(f, "$.name"))),
            "target_name": F.when(~plain, got(f, "$.target_name")), "data_type": F.when(~plain, got(f, "$.type")),
            "expression": F.when(~plain, got(f, "$.expression")),
        }

    def leaves(s):
        return {
            **{n: s[n] for n in ("id", "name", "description", "connection", "schema", "table", "role")},
            "type": F.coalesce(_filled(s["type"]), F.lit("unknown")),
            "sql": F.when(F.schema_of_variant(s["sql"]) == "STRING", got(s["sql"], "$")),
            "fields": _leaves(_leaves(s["fields"], parts), field),
        }

    def step(s, i):
        sid = F.coalesce(_filled(s["id"]), ordinal("step", i))
        table = _filled(s["table"])
        fields = _fields(s["fields"], lambda f: {n: f[n] for n in ("name", "target_name", "data_type", "expression")})
        values = {
            "step_id": sid, "name": F.coalesce(_filled(s["name"]), sid), "type": s["type"],
            "description": F.coalesce(s["description"], F.lit("")), "connection": s["connection"],
            "schema_name": s["schema"], "table_name": s["table"], "qualified": table,
            "role": F.when(table.isNotNull(), classify_role(s["type"], F.lit("json"), s["role"])),
            "sql": F.when(strip_space(s["sql"]) != "", s["sql"]), "fields": fields,
        }
        return _record(STEP_FIELDS, values)

    def hop(h, _i):
        off = F.to_json(h["enabled"]).isin("false", "null", "0", "0.0", '""', "[]", "{}")
        values = {
            "from_name": F.coalesce(h["from"], F.lit("")), "to_name": F.coalesce(h["to"], F.lit("")),
            "enabled": F.coalesce(~off, F.lit(True)),
        }
        return _record(HOP_FIELDS, values)

    return _doc(
        connections=_each(p["connections"], connection), steps=_each(_leaves(p["steps"], leaves), step), hops=_each(p["hops"], hop)
    )


def _item(kind: str, locator: Column, value: Column, **attrs: Column) -> Column:
    return _record(ITEM_FIELDS, {"kind": F.lit(kind), "locator": locator, "value": value, **attrs})


def _some(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def _pipeline_items(locator: Column | str, kind: Column | str) -> Column:
    name = F.col("_name")
    at, what = (F.lit(x) if isinstance(x, str) else x for x in (locator, kind))
    described = F.when(F.col("fmt") == "json", F.coalesce("_json.pipeline.description", F.lit("")))
    return F.array(
        _item("pipeline", at, name, name=name, type=what, description=described, source_sha256=F.col("source_sha256"))
    )


def _named_items(kind: str, prefix: str, section: Column, close: str = "]", shift: int = 0) -> Column:
    def build(x):
        extra = {
            "connection": {"type": x["type"], "config": x["config"]},
            "parameter": {"default_value": x["value"], "description": x["note"]},
            "variable": {"default_value": x["value"], "scope": x["note"]},
        }[kind]
        return _item(kind, _loc(prefix, x["at"] + shift, close), x["name"], name=x["name"], **extra)

    return F.transform(section, build)


def _step_items(prefix: str, shift: int, order: tuple[str, ...], slash: str, own_table_step: bool) -> Column:
    """Items of all steps: the step itself, then its parts in the format's order of discovery."""

    def build(s, n):
        at = _loc(prefix, n + shift, "]")
        sid = s["step_id"]

        def table(locator, name, role, keep, cls):
            own = {"step_id": sid, "classification": F.lit(cls)} if own_table_step else {}
            ends = (keep if own_table_step else F.lit(True)) & (role != "referenced")
            return _item(
                "table", locator, name, name=name, role=role, connection=s["connection"], is_table=keep, is_endpoint=ends, **own
            )

        def first_table():
            if own_table_step:
                return ~((s["role"] == "source") & F.array_contains(_array(s["refs"]), s["qualified"]))
            key = F.concat(s["qualified"], F.lit("\n"), s["role"])
            return F.when(F.col("fmt") == "json", F.lit(True)).otherwise(F.array_position(F.col("_table_keys"), key) == n + 1)

        def field(f):
            return _item(
                "field", _loc(at, f"{slash}fields" if slash == "." else f"{slash}fields/field", "[", f["at"] + shift - 1, "]"), f["name"],
                step_id=sid, name=f["name"], target_name=f["target_name"], data_type=f["data_type"], expression=f["expression"],
            )

        new_connection = F.array_position(F.col("_conns"), s["connection"]) == n + 1
        parts = {
            "connection": lambda: _some(
                F.when(new_connection, _item("connection", _loc(at, "/connection"), s["connection"], name=s["connection"], type=F.lit("reference")))
            ),
            "sql": lambda: _some(F.when(s["sql"].isNotNull(), _item("sql", _loc(at, f"{slash}sql"), s["sql"], step_id=sid))),
            "refs": lambda: F.transform(
                _array(s["refs"]),
                lambda r, j: table(
                    _loc(at, "/sql:FROM_OR_JOIN"), r, F.lit("source"), F.array_position(s["refs"], r) == j + 1, FROM_SQL
                ),
            ),
            "table": lambda: _some(
                F.when(s["qualified"].isNotNull(), table(_loc(at, f"{slash}table"), s["qualified"], s["role"], first_table(), STRUCTURAL))
            ),
            "fields": lambda: F.transform(_array(s["fields"]), field),
            "calls": lambda: _some(
                F.when(
                    s["calls"].isNotNull(),
                    _item(
                        "pipeline_dependency", _loc(at, "/filename"), s["calls"], step_id=sid, from_name=F.col("_name"),
                        to_name=s["calls"], classification=F.lit(STRUCTURAL),
                    ),
                )
            ),
        }
        head = F.array(
            _item(
                "step", at, _loc(s["name"], ":", s["type"]),
                **{c: s[c] for c in ("step_id", "name", "type", "description", "connection", "schema_name", "table_name")},
            )
        )
        return F.concat(head, *[parts[p]() for p in order])

    return F.flatten(F.transform(F.col("_doc.steps"), build))


def _hop_items(prefix: str, shift: int) -> Column:
    return F.transform(
        F.col("_doc.hops"),
        lambda h, i: _item(
            "hop", _loc(prefix, i + shift, "]"), _loc(h["from_name"], "->", h["to_name"]), from_name=h["from_name"],
            to_name=h["to_name"], enabled=h["enabled"],
        ),
    )


def _items() -> Column:
    """All items of a document in discovery order, which differs by format."""
    fmt = F.col("fmt")
    connections, parameters, variables = F.col("_doc.connections"), F.col("_doc.parameters"), F.col("_variables")
    hop = F.concat(
        _pipeline_items("./info/name", F.concat(F.lit("apache-hop-"), F.col("_root"))),
        _named_items("parameter", "./info/parameters/parameter[", parameters),
        _named_items("variable", ".//variables/variable[", variables),
        _step_items("./transform[", 1, ("connection", "fields", "sql", "table"), "/", False),
        _hop_items("./order/hop[", 1),
    )
    ktr = F.concat(
        _pipeline_items("./info/name", "pentaho-transformation"),
        _named_items("connection", "./connection[", connections),
        _named_items("parameter", "parameter[", parameters),
        _named_items("variable", "variable[", variables),
        _step_items("./step[", 1, ("sql", "refs", "table", "fields"), "/", True),
        _hop_items("./order/hop[", 1),
    )
    kjb = F.concat(
        _pipeline_items("./name", "pentaho-job"),
        _named_items("parameter", "parameter[", parameters),
        _named_items("variable", "variable[", variables),
        _step_items("./entries/entry[", 1, ("calls",), "/", True),
        _hop_items("job-hop[", 1),
    )
    legacy = F.concat(
        _pipeline_items("$.pipeline.name", "legacy-etl"),
        _named_items("connection", "$.connections[", connections, shift=-1),
        _step_items("$.steps[", 0, ("sql", "fields", "table"), ".", False),
        _hop_items("$.hops[", 0),
    )
    failed = F.array(_item("error", F.lit(None), F.col("error"), source_sha256=F.col("source_sha256")))
    return (
        F.when(F.col("error").isNotNull(), failed)
        .when(fmt == "hop", hop)
        .when(fmt == "ktr", ktr)
        .when(fmt == "kjb", kjb)
        .otherwise(legacy)
    )


def _markup_only(text: Column) -> Column:
    """The document with CDATA escaped and comments removed: any tag left in it is an element."""

    def escaped(piece: Column, i: Column) -> Column:
        end = F.instr(piece, "]]>")
        plain = F.left(piece, end - 1)
        for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            plain = F.replace(plain, F.lit(mark), F.lit(name))
        return F.when((i == 0) | (end == 0), piece).otherwise(F.concat(plain, F.substr(piece, end + 3)))

    joined = F.array_join(F.transform(F.split(text, r"<!\[CDATA\["), escaped), "")
    return F.regexp_replace(joined, r"(?s)<!--.*?-->", "")


def _is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


def _has_shape(doc: Column) -> Column:
    """Whether the sections of a JSON document that are there are lists of objects, with fields of texts or objects."""

    def objects(name: str) -> Column:
        absent = F.try_variant_get(doc, f"$.{name}", "variant").isNull()
        return absent | F.coalesce(F.forall(F.try_variant_get(doc, f"$.{name}", "array<variant>"), _sure_object), F.lit(False))

    def fields(step: Column) -> Column:
        found = F.try_variant_get(step, "$.fields", "array<variant>")
        return F.coalesce(F.forall(found, lambda f: _sure_object(f) | F.coalesce(F.schema_of_variant(f) == "STRING", F.lit(False))), F.lit(True))

    steps = F.try_variant_get(doc, "$.steps", "array<variant>")
    return objects("connections") & objects("steps") & objects("hops") & F.coalesce(F.forall(steps, fields), F.lit(True))


def _sure_object(value: Column) -> Column:
    return F.coalesce(_is_object(value), F.lit(False))


def extract(artifacts: DataFrame) -> DataFrame:
    """Discovered items of every artifact: one row per item with its position, evidence id and attributes.

    The file text leaves the plan before the rows multiply.
    """
    fmt, text = F.col("fmt"), F.col("content")
    built = _expressions(artifacts.sparkSession.sparkContext.applicationId)
    bare = _markup_only(text)
    blocks = F.regexp_extract_all(bare, F.lit(r"(?s)(<variables(?:\s[^>]*)?>.*?</variables>)"), 1)
    is_xml = fmt.isin("hop", "ktr", "kjb")
    wrapped = F.concat(F.lit("<all>"), F.array_join(blocks, ""), F.lit("</all>"))
    parsed = artifacts.withColumns(
        {
            "_hop": F.when(fmt == "hop", F.from_xml(text, HOP_SCHEMA, _XML)),
            "_ktr": F.when(fmt == "ktr", F.from_xml(text, KTR_SCHEMA, _XML)),
            "_kjb": F.when(fmt == "kjb", F.from_xml(text, KJB_SCHEMA, _XML)),
            "_value": F.when(fmt == "json", F.try_parse_json(text)),
            "_root": F.when(
                fmt == "hop", F.regexp_extract(bare, r"(?s)^\s*(?:<\?.*?\?>|<!DOCTYPE[^>]*>|\s)*<([^\s/>]+)", 1)
            ),
            "_vars": F.when(is_xml & text.contains("<variables"), F.from_xml(wrapped, _VARIABLES, _XML)),
            "_empty": F.trim(text) == "",
        }
    )
    is_doc = F.coalesce(_is_object(F.col("_value")), F.lit(False))
    malformed = F.coalesce(F.col("_hop._bad"), F.col("_ktr._bad"), F.col("_kjb._bad")).isNotNull()
    checked = parsed.withColumns(
        {
            "_json": F.when((fmt == "json") & is_doc, F.from_json(text, JSON_SCHEMA)),
            "error": F.when(F.col("error").isNotNull(), F.col("error"))
            .when(is_xml & (malformed | F.col("_empty")), F.lit("malformed XML"))
            .when((fmt == "json") & ~is_doc, F.lit("not a JSON object"))
            .when((fmt == "json") & ~_has_shape(F.col("_value")), F.lit("unexpected JSON shape"))
            .when(
                (fmt == "hop") & ~F.col("_root").isin("pipeline", "workflow"),
                F.concat(F.lit("unsupported Hop root element: "), "_root"),
            ),
        }
    )

    from_info = _text(F.coalesce(F.col("_hop.info.name"), F.col("_ktr.info.name")), F.col("stem"))
    job_name = F.coalesce(_filled(_text(F.col("_kjb.name"))), _text(F.col("_kjb.info.name"), F.col("stem")))
    cleaned = checked.select(
        "artifact_id", "path", "fmt", "source_sha256", "error", "_root", "_json",
        F.when(fmt == "kjb", job_name)
        .when(fmt == "json", F.coalesce(_filled(F.col("_json.pipeline.name")), F.col("stem")))
        .otherwise(from_info)
        .alias("_name"),
        _named(_inner(F.col("_vars.variables"), "variable"), _variable).alias("_variables"),
        F.when(F.col("error").isNotNull(), F.lit(None))
        .when(fmt == "hop", built["hop"])
        .when(fmt == "ktr", built["ktr"])
        .when(fmt == "kjb", built["kjb"])
        .otherwise(built["json"])
        .alias("_doc"),
    )
    keyed = cleaned.withColumns(
        {
            "_conns": F.transform("_doc.steps", lambda s: s["connection"]),
            "_table_keys": F.transform("_doc.steps", lambda s: F.concat(s["qualified"], F.lit("\n"), s["role"])),
        }
    )
    listed = keyed.select("artifact_id", "path", "fmt", built["items"].alias("_items"))
    # Every document has at least one item. The outer form only keeps the optimizer from testing the array for
    # emptiness below the projections, which would parse each document once more.
    sql_at = F.array_compact(F.transform("_items", lambda x, i: F.when(x["kind"] == "sql", i)))
    digest = F.sha2(F.to_json("_items"), 256)
    return listed.select(
        "artifact_id", "path", "fmt", sql_at.alias("_sql_at"), digest.alias("_digest"),
        F.posexplode_outer("_items").alias("position", "_i"),
    ).select(
        "artifact_id",
        "path",
        "fmt",
        "position",
        F.when(F.col("_i.kind") != "error", ordinal("ev", F.col("position") + 1)).alias("evidence_id"),
        F.when(F.col("_i.kind") == "sql", ordinal("sql", F.array_position("_sql_at", F.col("position")))).alias("sql_id"),
        F.when((F.col("position") == 0) & (F.col("_i.kind") != "error"), F.col("_digest")).alias("truth_digest"),
        "_i.*",
    )


def _only(fmt: str):
    def extract_one(artifacts: DataFrame) -> dict[str, DataFrame]:
        return metadata_tables(extract(artifacts.where(F.col("fmt") == fmt)))

    return extract_one


extract_hop_xml, extract_ktr, extract_kjb, extract_legacy_json = (_only(f) for f in ("hop", "ktr", "kjb", "json"))


def metadata_tables(items: DataFrame) -> dict[str, DataFrame]:
    """The normalized tables, each a filter and projection of the discovered items."""
    key = ["artifact_id", "position"]
    refs = F.array("evidence_id").alias("evidence_refs")

    def of(kind: str) -> DataFrame:
        return items.where(F.col("kind") == kind)

    def pick(kind: str, *columns) -> DataFrame:
        return of(kind).select(*key, *columns, refs)

    public = F.create_map(*[F.lit(x) for kv in PUBLIC_FORMAT.items() for x in kv])
    tables = of("table")
    endpoints = tables.where("is_endpoint").select(
        *key, F.col("role").alias("direction"), F.lit("table").alias("kind"), "name", "connection", "step_id",
        "classification", refs,
    )
    return {
        "pipelines": of("pipeline").select(
            *key, F.col("name").alias("id"), "name", F.col("type").alias("kind"), public[F.col("fmt")].alias("format"),
            F.col("path").alias("source_path"), "source_sha256", "truth_digest", "description", refs,
        ),
        "steps": pick("step", "step_id", "name", "type", "description", "connection", "schema_name", "table_name"),
        "hops": pick("hop", "from_name", "to_name", "enabled"),
        "sql_statements": pick("sql", "sql_id", "step_id", F.col("value").alias("statement")),
        "endpoints": endpoints,
        "tables": tables.where("is_table").select(*key, "name", "role", "connection", "step_id", "classification", refs),
        "fields": pick("field", "step_id", "name", "target_name", "data_type", "expression"),
        "connections": pick("connection", "name", "type", "config"),
        "parameters": pick("parameter", "name", "default_value", "description"),
        "variables": pick("variable", "name", F.col("default_value").alias("value"), "scope"),
        "dependencies": pick("pipeline_dependency", "from_name", "to_name", "step_id", "classification"),
        "evidence": items.where(F.col("evidence_id").isNotNull()).select(
            *key, F.col("evidence_id").alias("id"), F.col("path").alias("source_path"), "kind", "locator", "value"
        ),
        "errors": of("error").select("artifact_id", "path", F.col("value").alias("error")),
    }
