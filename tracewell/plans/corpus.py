"""A corpus with one definition file per order, and the items it must yield as SQL over the orders.

File text and expected items are stated separately: the text is parsed by the extraction, the items are computed
straight from the order's columns.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewell.plans.views import load
from tracewell.session import work_path
from tracewell.sources.artifacts import extract, metadata_tables, route_artifacts

KEYS = "o_orderkey AS k, o_custkey AS c"
FMT = "CASE k % 4 WHEN 0 THEN 'hop' WHEN 1 THEN 'ktr' WHEN 2 THEN 'json' ELSE 'kjb' END"
SUFFIX = (
    "CASE WHEN k % 89 = 3 THEN '.txt' ELSE CASE k % 4 WHEN 0 THEN '.hpl' WHEN 1 THEN '.KTR' "
    "WHEN 2 THEN '.json' ELSE '.kjb' END END"
)
PATH = f"concat('/corpus/a', k, {SUFFIX})"
ERROR = (
    f"CASE WHEN k % 89 = 3 THEN concat('unsupported ETL artifact: ', {PATH}) "
    "WHEN k % 97 = 5 THEN CASE WHEN k % 4 = 2 THEN 'not a JSON object' ELSE 'malformed XML' END "
    "WHEN k % 4 = 0 AND k % 101 = 0 THEN 'unsupported Hop root element: project' END"
)
ROOT = "CASE WHEN k % 101 = 0 THEN 'project' WHEN c % 7 = 0 THEN 'workflow' ELSE 'pipeline' END"
SQL_TEXT = (
    "SELECT r.meter, r.kwh FROM grid.readings_@(c % 7)@ r JOIN assets.meters_@(c % 3)@ m ON r.meter = m.id "
    "WHERE m.state = 'BILLABLE' AND r.kwh {lt} 900"
)


def _concat(text: str) -> str:
    """SQL concatenation of a text in which ``@(expr)@`` stands for a value."""
    parts = re.split(r"@\((.*?)\)@", text)
    quoted = [f"'{p.replace(chr(39), chr(39) * 2)}'" if i % 2 == 0 else f"({p})" for i, p in enumerate(parts)]
    return "concat(" + ", ".join(quoted) + ")"


def _spark_concat(text: str) -> str:
    parts = re.split(r"@\((.*?)\)@", text)
    quoted = [
        ('"' + p.replace("\\", "\\\\").replace('"', '\\"') + '"') if i % 2 == 0 else f"({p})" for i, p in enumerate(parts)
    ]
    return "concat(" + ", ".join(quoted) + ")"


def _document(*parts: str | tuple[str, str]) -> str:
    """Spark SQL for a file text; a pair is a condition and a text that is there only when it holds."""
    pieces = [
        _spark_concat(p) if isinstance(p, str) else f"CASE WHEN {p[0]} THEN {_spark_concat(p[1])} ELSE '' END" for p in parts
    ]
    return "concat(" + ", ".join(pieces) + ")"


NAMED = "k % 13 <> 0"
FILTERED, JOINED, REJECTS, PLUGIN, AGAIN = "c % 3 <> 1", "c % 4 = 2", "c % 5 = 3", "c % 6 = 0", "c % 10 = 1"

# Steps of an XML flow in file order: the condition under which a step is there, and its name. How many there are, and
# how they branch, follows from the order's customer.
FLOW = [
    ("true", "Pull Readings"), ("true", "Sort By Meter"), (PLUGIN, ""), (FILTERED, "Keep Billable"), ("true", "Usage Per Meter"),
    ("true", "Late Readings"), (JOINED, "Join Late"), ("true", "Find Tariff"), (REJECTS, "Write Rejects"), ("true", "Write Bills"),
    (AGAIN, "Late Readings"),
]
# Hops in file order: condition, from, to, how the switch is written (None: not at all), and whether it is on.
OFF = "c % 8 = 0"
HOPS = [
    ("true", "Pull Readings", "Sort By Meter", "Y", "true"),
    (FILTERED, "Sort By Meter", "Keep Billable", None, "true"),
    (FILTERED, "Keep Billable", "Usage Per Meter", " y ", "true"),
    ("c % 3 = 1", "Sort By Meter", "Usage Per Meter", "yes", "true"),
    (JOINED, "Late Readings", "Join Late", None, "true"),
    (JOINED, "Join Late", "Find Tariff", "Y", "true"),
    ("c % 4 <> 2", "Late Readings", "Find Tariff", None, "true"),
    ("true", "Usage Per Meter", "Find Tariff", "", "true"),
    (REJECTS, "Find Tariff", "Write Rejects", "N", "false"),
    ("true", "Find Tariff", "Write Bills", f"@(CASE WHEN {OFF} THEN 'n' ELSE 'Y' END)@", f"NOT ({OFF})"),
    ("c % 10 = 0", "Pull Readings", "Sort By Meter", None, "true"),
    ("c % 9 = 0", "Write Bills", "Late Readings", None, "true"),
    ("c % 14 = 0", "Nowhere", "Write Bills", None, "true"),
]


def _hop_text(cond: str, source: str, target: str, switch: str | None, _on: str) -> tuple[str, str]:
    enabled = "" if switch is None else f"<enabled>{switch}</enabled>"
    return cond, f"<hop><from>{source}</from><to>{target}</to>{enabled}</hop>"


ORDER = [_hop_text(*h) for h in HOPS]


def _xml_steps(tag: str) -> list:
    hop = tag == "transform"
    peak = (
        "<stream_name>peak</stream_name><column_name>peak_kw</column_name>"
        if hop
        else "<field_name>peak</field_name><rename>peak_kw</rename><formula>greatest(kw)</formula>"
    )
    tariffs = "<table>tariffs</table>"
    if not hop:
        tariffs = f"@(CASE WHEN k % 8 = 1 THEN '<lookup>{tariffs}</lookup>' ELSE '{tariffs}' END)@"
    late = "<type>TableInput</type><connection>side_@(c % 2)@</connection><schema>grid</schema><table>late_@(c % 4)@</table>"
    written = "<connection>books</connection><schema>billing</schema>"
    inner = [
        [f"<type>TableInput</type><connection>grid_@(c % 5)@</connection><sql>{SQL_TEXT.format(lt='&lt;')}</sql>"],
        ["<type>SortRows</type>"],
        ["<type>PhaseSplitter</type><description>built on site</description>"],
        ["<type>FilterRows</type>"],
        ["<type>GroupBy</type><fields><field><name>usage</name><type>Number</type>" + ("" if hop else "<calculation>kwh</calculation>") + "</field>",
         ("c % 4 = 1", "<field><name></name></field>"), ("c % 2 = 0", f"<field>{peak}</field>"), "</fields>"],
        [late],
        ["<type>MergeJoin</type>"],
        ["<type>DimensionLookup</type><connection>grid_@(c % 5)@</connection><schema>rates</schema>" + tariffs],
        [f"<type>TextFileOutput</type>{written}<table>rejects</table>"],
        [f"<type>TableOutput</type>{written}<table>due_@(k % 11)@</table>"],
        [late],
    ]
    out: list = []
    for (cond, name), parts in zip(FLOW, inner, strict=True):
        title = f"<name> {name}\n</name>" if name == "Pull Readings" else f"<name>{name}</name>" if name else ""
        whole = [f"<{tag}>{title}", *parts, f"</{tag}>"]
        for part in whole:
            both, text = part if isinstance(part, tuple) else ("true", part)
            out.append(text if cond == both == "true" else (" AND ".join(f"({x})" for x in (cond, both)), text))
    return out


_ROOM = "<variables><variable><name>METER_ROOM</name><value>room_@(c % 5)@</value></variable></variables>"
_PERIOD = "<parameter><name> PERIOD </name><default_value>quarter @(k % 4)@</default_value><description>billed span</description></parameter>"
_UNIT = "<parameter><name>UNIT</name><default>kilo</default></parameter>"

HOP_TEXT = _document(
    '<?xml version="1.0" encoding="UTF-8"?>\n<!-- <transform><name>retired</name></transform> -->\n' + f"<@({ROOT})@><info>",
    (NAMED, "<name>bill_@(k)@</name>"),
    f"<parameters>{_PERIOD}",
    ("c % 3 = 0", f"<parameter><name/></parameter>{_UNIT}"),
    "</parameters>",
    ("k % 3 = 0", f"<site>{_ROOM}</site>"),
    "</info>",
    *_xml_steps("transform"),
    "<order>",
    *ORDER,
    f"</order></@({ROOT})@>",
)
KTR_TEXT = _document(
    "<transformation>",
    ("k % 3 = 0", _ROOM),
    "<order>",
    *ORDER,
    "</order><info>",
    (NAMED, "<name>bill_@(k)@</name>"),
    f"<parameters>{_PERIOD}</parameters></info>",
    ("c % 3 = 0", f"<parameters>{_UNIT}</parameters>"),
    ("c % 4 = 0", "<connection><name/></connection>"),
    "<connection><name>books</name></connection>",
    "<connection><name>grid_main</name><type>ORACLE</type><server>meters-@(c % 4)@</server><database>grid</database>"
    "<port>1521</port></connection>",
    *_xml_steps("step"),
    "</transformation>",
)
KJB_TEXT = _document(
    "<job>",
    (NAMED, "<name>bill_@(k)@</name>"),
    "<parameters><parameter><name>CYCLE</name><default_value>monthly</default_value></parameter></parameters><entries>"
    "<entry><name>START</name><type>SPECIAL</type></entry>",
    ("c % 3 = 0", "<entry><name>Wait For Grid</name><type>DELAY</type><filename>none.txt</filename></entry>"),
    ("c % 2 = 0", "<entry><name>Run Billing</name><type>TRANS</type><filename>a@(k + 1)@.ktr</filename></entry>"),
    ("c % 2 = 1", "<entry><name>Run Billing</name><type>Job</type><filename/><jobname>bill_@(k + 1)@</jobname></entry>"),
    "</entries><hops><hop><from>START</from><to>Run Billing</to><enabled>@(CASE WHEN c % 8 = 0 THEN 'N' ELSE 'Y' END)@</enabled></hop></hops>"
    "<order>",
    ("c % 3 = 0", "<hop><from>START</from><to>Wait For Grid</to></hop>"),
    "</order></job>",
)
JSON_TEXT = _document(
    '{"pipeline": {"description": "billing run"',
    (NAMED, ', "name": "bill_@(k)@"'),
    '}, "connections": [{"host": "x"}, {"name": "grid", "type": "oracle", "host": "h@(c % 3)@", "password": "p@(k)@"}], "steps": ['
    '{"id": "codes", "type": "CustomReader", "table": "rates.codes_@(c % 3)@"}, '
    '{"id": "pull", "name": "Pull Readings", "type": "TableInput", "connection": "grid", "table": "grid.readings_@(c % 7)@", '
    f'"sql": "{SQL_TEXT.format(lt="<")}", "fields": [{{"name": "kwh", "type": "Number", "target_name": "used"}}, "meter"]}}, '
    '{"name": "Sort By Meter", "type": "SortRows"}, ',
    (FILTERED, '{"id": "keep", "name": "Keep Billable", "type": "FilterRows"}, '),
    '{"id": "bills", "name": "Write Bills", "type": "TableOutput", "table": "billing.due_@(k % 11)@", '
    '"fields": [{"name": "due", "expression": "used*rate"}, {"name": ""}]}, '
    '{"id": "stamp", "name": "Stamp", "type": "TableOutput", "role": "Referenced", "table": "ref.stamps"}], "hops": ['
    '{"from": "codes", "to": "Write Bills"}, {"from": "Pull Readings", "to": "Sort By Meter", "enabled": true}',
    (FILTERED, ', {"from": "Sort By Meter", "to": "Keep Billable"}, {"from": "Keep Billable", "to": "Write Bills", "enabled": "no"}'),
    ("c % 3 = 1", """, {"from": "Sort By Meter", "to": "Write Bills", "enabled": @(CASE WHEN c % 8 = 0 THEN 'false' ELSE '"false"' END)@}"""),
    ("c % 9 = 0", ', {"from": "Write Bills", "to": "codes"}'),
    "]}",
)


def artifact_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One definition file per order: four formats, some broken, some unsupported."""
    keyed = load(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c")
    keyed = keyed.repartition(2 * spark.sparkContext.defaultParallelism, "k")
    text = f"CASE k % 4 WHEN 0 THEN {HOP_TEXT} WHEN 1 THEN {KTR_TEXT} WHEN 2 THEN {JSON_TEXT} ELSE {KJB_TEXT} END"
    files = keyed.selectExpr(f"{PATH} AS path", f"{text} AS full", "k % 97 = 5 AS broken")
    cut = F.when(F.col("broken"), F.left("full", F.length("full") - 2)).otherwise(F.col("full"))
    return route_artifacts(files.select("path", cut.alias("content"), F.sha2(F.encode(cut, "UTF-8"), 256).alias("source_sha256")))


_STORED: dict[tuple[str, str], str] = {}


def stored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus extracted once per session and kept as a table in the shared folder."""
    where = (spark.sparkContext.applicationId, sf_dir)
    if where not in _STORED:
        path = work_path(spark, "items")
        extract(artifact_src(spark, sf_dir)).write.parquet(path)
        _STORED[where] = path
    return spark.read.parquet(_STORED[where])


def stored_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return metadata_tables(stored_items(spark, sf_dir))


# Expected items, in discovery order: (condition, kind, locator, value, attributes); texts hold @(expr)@ values.
COLUMNS = {
    "step_id": "VARCHAR", "name": "VARCHAR", "type": "VARCHAR", "description": "VARCHAR", "connection": "VARCHAR",
    "schema_name": "VARCHAR", "table_name": "VARCHAR", "target_name": "VARCHAR", "data_type": "VARCHAR",
    "expression": "VARCHAR", "default_value": "VARCHAR", "scope": "VARCHAR", "from_name": "VARCHAR", "to_name": "VARCHAR",
    "role": "VARCHAR", "classification": "VARCHAR", "enabled": "BOOLEAN", "is_table": "BOOLEAN", "is_endpoint": "BOOLEAN",
}
STATEMENT = SQL_TEXT.format(lt="<")


def _expect_step(locator: str, number: str, name: str, stype: str, cond: str = "true", **attrs: str):
    attrs.setdefault("description", "")
    return (cond, "step", locator, f"{name}:{stype}", {"step_id": number, "name": name, "type": stype, **attrs})


def _expect_table(cond: str, locator: str, name: str, role: str, keep: str = "true", **attrs: str):
    end = keep if role != "referenced" else "false"
    return (cond, "table", locator, name, {"name": name, "role": role, "=is_table": keep, "=is_endpoint": end, **attrs})


def _expect_hops(prefix: str, start: int, rows: list[tuple[str, str, str, str]]):
    """Rows of (condition, from, to, enabled); the position counts the rows that are there."""
    out, before = [], str(start)
    for cond, a, b, enabled in rows:
        out.append((cond, "hop", f"{prefix}@({before})@]", f"{a}->{b}", {"from_name": a, "to_name": b, "=enabled": enabled}))
        before += f" + (CASE WHEN {cond} THEN 1 ELSE 0 END)"
    return out


def _place(flow: list[tuple[str, str]], n: int) -> str:
    """Number of the n-th possible step among those that are there."""
    before = [cond for cond, _ in flow[:n] if cond != "true"]
    return " + ".join([str(1 + n - len(before)), *[f"(CASE WHEN {cond} THEN 1 ELSE 0 END)" for cond in before]])


def _step_id(place: str) -> str:
    return f"step-@(lpad(CAST({place} AS VARCHAR), 4, '0'))@"


def _expect_xml(tag: str, hop: bool):
    names = [name for _, name in FLOW]
    rows: list = []

    def step(n, stype, name=None, **attrs):
        place = _place(FLOW, n)
        at, sid, cond = f"./{tag}[@({place})@]", _step_id(place), FLOW[n][0]
        rows.append(_expect_step(at, sid, name or names[n], stype, cond, **attrs))
        return at, sid, cond

    def connection(at, cond, name, first="true"):
        if hop:
            rows.append((f"({cond}) AND ({first})", "connection", at + "/connection", name, {"name": name, "type": "reference"}))

    def table(at, sid, cond, name, role, conn, keep="true"):
        more = {} if hop else {"step_id": sid, "classification": "structural"}
        row = _expect_table(cond, at + "/table", name, role, keep, connection=conn, **more)
        if hop and role != "referenced":
            row[4]["=is_endpoint"] = "true"
        rows.append(row)

    def field(at, sid, cond, pos, name, **attrs):
        rows.append((cond, "field", f"{at}/fields/field[{pos}]", name, {"step_id": sid, "name": name, **attrs}))

    def late(n, keep):
        attrs = {"connection": "side_@(c % 2)@", "schema_name": "grid", "table_name": "late_@(c % 4)@"}
        at, sid, cond = step(n, "TableInput", **attrs)
        connection(at, cond, "side_@(c % 2)@", keep)
        table(at, sid, cond, "grid.late_@(c % 4)@", "source", "side_@(c % 2)@", keep if hop else "true")

    at, sid, _ = step(0, "TableInput", connection="grid_@(c % 5)@")
    connection(at, "true", "grid_@(c % 5)@")
    rows.append(("true", "sql", at + "/sql", STATEMENT, {"step_id": sid}))
    for name in () if hop else ("grid.readings_@(c % 7)@", "assets.meters_@(c % 3)@"):
        found = {"step_id": sid, "connection": "grid_@(c % 5)@", "classification": "inferred-deterministic-sql-reference"}
        rows.append(_expect_table("true", at + "/sql:FROM_OR_JOIN", name, "source", **found))
    step(1, "SortRows")
    place = _place(FLOW, 2)
    step(2, "PhaseSplitter", f"step-@({place})@" if hop else _step_id(place), description="built on site")
    step(3, "FilterRows")
    at, sid, _ = step(4, "GroupBy")
    field(at, sid, "true", "1", "usage", data_type="Number", **({} if hop else {"expression": "kwh"}))
    peak = {"target_name": "peak_kw"} | ({} if hop else {"expression": "greatest(kw)"})
    field(at, sid, "c % 2 = 0", "@(2 + (CASE WHEN c % 4 = 1 THEN 1 ELSE 0 END))@", "peak", **peak)
    late(5, "true")
    step(6, "MergeJoin")
    tariffs = {"connection": "grid_@(c % 5)@", "schema_name": "rates", "table_name": "tariffs"}
    at, sid, cond = step(7, "DimensionLookup", **tariffs)
    table(at, sid, cond, "rates.tariffs", "referenced", "grid_@(c % 5)@")
    for n, stype, name in ((8, "TextFileOutput", "rejects"), (9, "TableOutput", "due_@(k % 11)@")):
        at, sid, cond = step(n, stype, connection="books", schema_name="billing", table_name=name)
        connection(at, cond, "books", "true" if n == 8 else f"NOT ({REJECTS})")
        table(at, sid, cond, f"billing.{name}", "target", "books")
    late(10, "false")
    return [*rows, *_expect_hops("./order/hop[", 1, [(cond, a, b, on) for cond, a, b, _, on in HOPS])]


def _parameter(cond: str, locator: str, name: str, default: str, description: str):
    return (cond, "parameter", locator, name, {"name": name, "default_value": default, "description": description})


def _variable(locator: str):
    attrs = {"name": "METER_ROOM", "default_value": "room_@(c % 5)@", "scope": "artifact"}
    return ("k % 3 = 0", "variable", locator, "METER_ROOM", attrs)


def _conn(cond: str, locator: str, name: str, ctype: str):
    return (cond, "connection", locator, name, {"name": name, "type": ctype})


_NAME = "@(CASE WHEN k % 13 = 0 THEN concat('a', k) ELSE concat('bill_', k) END)@"


def _pipe(locator: str, kind: str, **attrs):
    return ("true", "pipeline", locator, _NAME, {"name": _NAME, "type": kind, **attrs})


def _json_field(step: int, sid: str, pos: int, name: str, **attrs):
    return ("true", "field", f"$.steps[{step}].fields[{pos}]", name, {"step_id": sid, "name": name, **attrs})


_PERIOD_ROW = ("PERIOD", "quarter @(k % 4)@", "billed span")
_CALLED = "@(CASE WHEN c % 2 = 0 THEN concat('a', k + 1, '.ktr') ELSE concat('bill_', k + 1) END)@"
_JOB = [("true", "START"), ("c % 3 = 0", "Wait For Grid"), ("true", "Run Billing")]
_RUN_AT, _RUN_ID = f"./entries/entry[@({_place(_JOB, 2)})@]", _step_id(_place(_JOB, 2))
_JSON_LAST = "3 + (CASE WHEN c % 3 <> 1 THEN 1 ELSE 0 END)"


def _json_at(more: int, rest: str) -> str:
    return f"$.steps[@({_JSON_LAST} + {more})@]{rest}"


EXPECTED = {
    "hop": [
        _pipe("./info/name", f"apache-hop-@({ROOT})@"),
        _parameter("true", "./info/parameters/parameter[1]", *_PERIOD_ROW),
        _parameter("c % 3 = 0", "./info/parameters/parameter[3]", "UNIT", "kilo", ""),
        _variable(".//variables/variable[1]"),
        *_expect_xml("transform", True),
    ],
    "ktr": [
        _pipe("./info/name", "pentaho-transformation"),
        _conn("true", "./connection[@(CASE WHEN c % 4 = 0 THEN 2 ELSE 1 END)@]", "books", "database"),
        _conn("true", "./connection[@(CASE WHEN c % 4 = 0 THEN 3 ELSE 2 END)@]", "grid_main", "ORACLE"),
        _parameter("true", "parameter[1]", *_PERIOD_ROW),
        _parameter("c % 3 = 0", "parameter[2]", "UNIT", "kilo", ""),
        _variable("variable[1]"),
        *_expect_xml("step", False),
    ],
    "kjb": [
        _pipe("./name", "pentaho-job"),
        _parameter("true", "parameter[1]", "CYCLE", "monthly", ""),
        _expect_step("./entries/entry[1]", "step-0001", "START", "SPECIAL"),
        _expect_step("./entries/entry[2]", "step-0002", "Wait For Grid", "DELAY", "c % 3 = 0"),
        _expect_step(_RUN_AT, _RUN_ID, "Run Billing", "@(CASE WHEN c % 2 = 0 THEN 'TRANS' ELSE 'Job' END)@"),
        ("true", "pipeline_dependency", f"{_RUN_AT}/filename", _CALLED,
         {"step_id": _RUN_ID, "from_name": _NAME, "classification": "structural", "to_name": _CALLED}),
        *_expect_hops("job-hop[", 1, [("true", "START", "Run Billing", f"NOT ({OFF})"), ("c % 3 = 0", "START", "Wait For Grid", "true")]),
    ],
    "json": [
        _pipe("$.pipeline.name", "legacy-etl", description="billing run"),
        _conn("true", "$.connections[0]", "connection-1", "unknown"),
        _conn("true", "$.connections[1]", "grid", "oracle"),
        _expect_step("$.steps[0]", "codes", "codes", "CustomReader", table_name="rates.codes_@(c % 3)@"),
        _expect_table("true", "$.steps[0].table", "rates.codes_@(c % 3)@", "source"),
        _expect_step("$.steps[1]", "pull", "Pull Readings", "TableInput", connection="grid", table_name="grid.readings_@(c % 7)@"),
        ("true", "sql", "$.steps[1].sql", STATEMENT, {"step_id": "pull"}),
        _json_field(1, "pull", 0, "kwh", target_name="used", data_type="Number"),
        _json_field(1, "pull", 1, "meter"),
        _expect_table("true", "$.steps[1].table", "grid.readings_@(c % 7)@", "source", connection="grid"),
        _expect_step("$.steps[2]", "step-0003", "Sort By Meter", "SortRows"),
        _expect_step("$.steps[3]", "keep", "Keep Billable", "FilterRows", FILTERED),
        _expect_step(_json_at(0, ""), "bills", "Write Bills", "TableOutput", table_name="billing.due_@(k % 11)@"),
        ("true", "field", _json_at(0, ".fields[0]"), "due", {"step_id": "bills", "name": "due", "expression": "used*rate"}),
        _expect_table("true", _json_at(0, ".table"), "billing.due_@(k % 11)@", "target"),
        _expect_step(_json_at(1, ""), "stamp", "Stamp", "TableOutput", table_name="ref.stamps"),
        _expect_table("true", _json_at(1, ".table"), "ref.stamps", "referenced"),
        *_expect_hops("$.hops[", 0, [
            ("true", "codes", "Write Bills", "true"), ("true", "Pull Readings", "Sort By Meter", "true"),
            (FILTERED, "Sort By Meter", "Keep Billable", "true"), (FILTERED, "Keep Billable", "Write Bills", "true"),
            ("c % 3 = 1", "Sort By Meter", "Write Bills", f"NOT ({OFF})"), ("c % 9 = 0", "Write Bills", "codes", "true"),
        ]),
    ],
}
for _row in EXPECTED["json"]:
    if _row[1] == "table":
        _row[4]["=is_table"] = "true"
# A referenced table in XML is kept as a table although it is no endpoint.


def _items_sql() -> str:
    selects = []
    for fmt, rows in EXPECTED.items():
        for n, (cond, kind, locator, value, attrs) in enumerate(rows):
            columns = []
            for c, t in COLUMNS.items():
                if f"={c}" in attrs:
                    columns.append(f"CAST({attrs[f'={c}']} AS {t}) AS {c}")
                elif c in attrs:
                    columns.append(f"{_concat(attrs[c])} AS {c}")
                else:
                    columns.append(f"CAST(NULL AS {t}) AS {c}")
            selects.append(
                f"SELECT k, c, artifact_id, '{fmt}' AS fmt, {n} AS ord, '{kind}' AS kind, {_concat(locator)} AS locator, "
                f"{_concat(value)} AS value, {', '.join(columns)} FROM src WHERE fmt = '{fmt}' AND {cond}"
            )
    return (
        f"keyed AS (SELECT {KEYS} FROM orders), src AS (SELECT k, c, {FMT} AS fmt, {PATH} AS artifact_id FROM keyed "
        f"WHERE {ERROR} IS NULL),\nraw_items AS ({' UNION ALL '.join(selects)}),\n"
        "items AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) - 1 AS position, "
        "printf('ev-%04d', row_number() OVER (PARTITION BY k ORDER BY ord)) AS evidence_id, "
        "CASE WHEN kind = 'sql' THEN printf('sql-%04d', row_number() OVER (PARTITION BY k, kind ORDER BY ord)) END AS sql_id "
        "FROM raw_items)"
    )


ITEMS_SQL = _items_sql()
