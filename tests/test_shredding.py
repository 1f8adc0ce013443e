import json

from pyspark.sql import functions as F

from millrace.operators.shredding import LEAF, MAP, RECORD_NAMES, RECORD_SHAPE, VALUES, assemble, child_table, listed, parse_record, shred, shredded_children, struct, tables_of


def brute(raw_id, line):
    """Children of a line, walked naively."""
    try:
        record = json.loads(line) if line is not None else None
    except ValueError:
        return set()
    if not isinstance(record, dict):
        return set()

    def content(v):
        if isinstance(v, str):
            try:
                d = json.loads(v)
                return d if isinstance(d, (dict, list)) else v
            except ValueError:
                return v
        return v

    def items(v):
        v = content(v)
        if isinstance(v, list):
            pairs = list(enumerate(v))
        elif isinstance(v, dict) and v:
            pairs = [(int(k), x) for k, x in v.items()] if all(k.isdigit() for k in v) else [(0, v)]
        else:
            pairs = []
        return [(i, content(x)) for i, x in pairs if isinstance(content(x), dict)]

    out = set()
    for kind in ("checks", "coverage_stats"):
        out |= {(raw_id, f"{kind}[{i}]") for i, _ in items(record.get(kind))}
    component = content(record.get("function_component"))
    if isinstance(component, dict):
        for i, a in items(component.get("argument_definitions_lsp")):
            path = f"function_component.argument_definitions_lsp[{i}]"
            out.add((raw_id, path))
            out |= {(raw_id, f"{path}.definitions[{j}]") for j, _ in items(a.get("definitions"))}

    def leaves(v, path):
        if isinstance(v, dict):
            for k, x in v.items():
                leaves(x, f"{path}.{k}")
        elif v is not None:
            out.add((raw_id, path))

    if isinstance(content(record.get("metadata")), dict):
        leaves(content(record["metadata"]), "metadata")
    return out


LINES = [
    '{"checks": {"1": {"compilation": true}, "2": null}, "coverage_stats": "[{\\"covered_lines\\": 1}, null, {\\"total_lines\\": 2}]"}',
    '{"function_component": {"argument_definitions_lsp": [null, {"name": "a", "definitions": [0, {"type_name": "x"}]}, {"name": "b"}, {"name": "c", "definitions": {"type_name": "z"}}]}}',
    '{"function_component": "{\\"argument_definitions_lsp\\": {\\"10\\": {\\"definitions\\": \\"[]\\"}, \\"2\\": {}}}", "checks": {}}',
    '{"metadata": {"a": "", "b": null, "c": {"d": {"e": 3}, "f": null}}, "checks": [[], "n/a", {}, {"tests": false}]}',
    '{"checks": [1]} trailing', "{", "", "   ", "null", "[1]", None, '{"checks": NaN}', '{"checks": [{"tests": true}]',
]


def test_children_equal_a_naive_walk(spark):
    rows = [(i, x, "other") for i, x in enumerate(LINES)] + [(100, LINES[0], "repeated")]
    df = spark.createDataFrame(rows, "raw_id long, json_line string, node_path string")  # a clashing extra column
    got = {tuple(r) for r in shredded_children(df, "raw_id", "json_line").select("raw_id", "node_path").collect()}
    want = set().union(*(brute(i, x) for i, x, _ in rows if x != '{"checks": NaN}'))
    assert got == want


def test_raw_lines_equal_a_naive_walk(spark, small):
    df = spark.read.parquet(f"{small}/detailed_results_raw.parquet")
    got = {tuple(r) for r in shredded_children(df, "raw_id", "json_line").select("raw_id", "node_path").collect()}
    assert got == set().union(*(brute(r.raw_id, r.json_line) for r in df.collect()))


def test_levels_rebuild_tables():
    columns = shred([parse_record(LINES[1]), None, parse_record(LINES[0])])
    t = assemble(columns, "function_component.argument_definitions_lsp[].definitions[]", ("function_component.argument_definitions_lsp[]",))
    assert t[["record", "position_1", "position_2", "type_name"]].values.tolist() == [[0, 1, 1, "x"], [0, 3, 0, "z"]]
    assert columns["checks[].#"].rep == [0, 0, 0] and columns["checks[].#"].dfn == [0, 0, 1]


def test_empty_table_and_parents(spark):
    empty = spark.createDataFrame([], "raw_id long, json_line string")
    assert shredded_children(empty, "raw_id", "json_line").count() == 0
    one = shredded_children(spark.createDataFrame([(1, LINES[1])], "raw_id long, json_line string"), "raw_id", "json_line")
    d = child_table(one, "definitions", "raw_id", {"type_name": "string"}).orderBy("node_path").collect()
    assert [(r.parent_path[-3:], r.position, r.type_name) for r in d] == [("[1]", 1, "x"), ("[3]", 0, "z")]


def test_very_long_list(spark):
    line = json.dumps({"checks": [{"tests": True}, None] * 20_000})
    df = spark.createDataFrame([(1, line)], "raw_id long, json_line string")
    r = shredded_children(df, "raw_id", "json_line").agg(F.count("*"), F.max(F.col("position").cast("int"))).first()
    assert tuple(r) == (20_000, 39_998)


def test_tables_of_a_shape():
    arguments = "function_component.argument_definitions_lsp[]"
    want = {"checks": ("checks[]", (), False), "coverage_stats": ("coverage_stats[]", (), False), "arguments": (arguments, (), False), "definitions": (f"{arguments}.definitions[]", (arguments,), False), "metadata": ("metadata[]", (), True)}
    assert tables_of(RECORD_SHAPE, RECORD_NAMES) == want
    assert set(tables_of(struct(a=listed(x=VALUES), b=listed(x=VALUES)))) == {"a", "x", "b", "b[].x"}


def test_another_shape(spark):
    shape = struct(xs=listed(a=struct(b=LEAF, deep=struct(ys=listed(v=LEAF), w=LEAF)), c=LEAF, tags=VALUES, meta=MAP), words=VALUES, top=struct(info=MAP))
    records = [
        {"xs": [{"a": {"b": 1, "deep": {"ys": [{"v": 5}, 0, {"v": 6}], "w": "w"}}, "c": "c0", "tags": ["t", None, 3, {"no": 1}], "meta": {"k": {"m": 1}, "n": None}}, 7, {"c": "c2"}, {"a": {"b": None}, "meta": {"q": ""}}], "words": ["x", [1], "y"], "top": {"info": {"z": True}}},
        {"words": "no list", "xs": {"a": {"b": 2}}}, {},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "id long, line string")
    got = {(r.id, r.node_table, r.node_path, r.parent_path, tuple(sorted(r.attributes.items()))) for r in shredded_children(df, "id", "line", shape, None).collect()}
    assert got == {
        (0, "xs", "xs[0]", "", (("a.b", "1"), ("a.deep.w", "w"), ("c", "c0"))), (0, "xs", "xs[2]", "", (("c", "c2"),)), (0, "xs", "xs[3]", "", ()), (1, "xs", "xs[0]", "", (("a.b", "2"),)),
        (0, "ys", "xs[0].a.deep.ys[0]", "xs[0]", (("v", "5"),)), (0, "ys", "xs[0].a.deep.ys[2]", "xs[0]", (("v", "6"),)), (0, "tags", "xs[0].tags[0]", "xs[0]", (("value", "t"),)), (0, "tags", "xs[0].tags[2]", "xs[0]", (("value", "3"),)),
        (0, "meta", "xs[0].meta.k.m", "xs[0]", (("value", "1"),)), (0, "meta", "xs[3].meta.q", "xs[3]", (("value", ""),)), (0, "words", "words[0]", "", (("value", "x"),)), (0, "words", "words[2]", "", (("value", "y"),)),
        (0, "info", "top.info.z", "", (("value", "true"),)),
    }
