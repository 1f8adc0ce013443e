import numpy as np
import pytest

from millrace.llm.generated_files import FEATURES, THIRD_PARTY, TOOL_NAME, describe, header_end, not_handwritten

NOTICES = [
    ("// Code generated by idlforge v4.17. DO NOT EDIT.", 1), ("# Diese Datei wurde von bindcraft automatisch erzeugt - nicht bearbeiten.", 1), ("/*\n * Generated on build by bindcraft, do not touch\n */", 1), ("# @generated by lexloom", 1), ('// <auto-generated tool="x" />', 1),
    ("// DO NOT MODIFY: written by `idlforge --emit drum`", 1), ("# AUTO-GENERATED FILE - changes will be lost", 1), ("// Regenerate with: make hedge-stubs  (hand edits are overwritten)", 1), ("// このファイルは bindcraft により自動生成されました", 1), ("# machine-written bindings, source: creek.proto", 1),
    ("// Vendored from https://code.sorrel.example/fencekit at v2.31.1; local changes: none", 2), ("# Origin: fennick/havenkit@1899ee63eabd", 2), ("// Taken verbatim from the Oakum runtime library, version 3.3", 2), ("// Copyright (c) 2020 The Brindle Authors. Copied unmodified from kernelkit 1.19.", 2),
    ("// Was auto-generated once, now maintained by hand.", 0), ("// The generated report is checked by hand.", 0), ("// Do not edit the returned slice; copy it first.", 0), ("// Vendor names come from the invoice, not from the catalogue.", 0), ("// See minify() for the compressed output.", 0), ("# The generated test expects 9 items under load.", 0),
]
BODY = 'func run(a int) int {\n\tbanner := "// Code generated by stubsmith v1. DO NOT EDIT."\n\treturn a\n}\n'


@pytest.mark.parametrize("notice, kind", NOTICES)
def test_notices(notice, kind):
    assert describe(f"{notice}\n\npackage x\n\n{BODY}")[1] == kind
    assert describe(f"package x\n\n{BODY}\n{notice}\n")[1] == kind


def test_notice_is_hidden_from_features():
    plain, noted = describe(f"package x\n\n{BODY}")[0], describe(f"// Code generated by t. DO NOT EDIT.\n\npackage x\n\n{BODY}")[0]
    assert plain == noted and len(plain) == len(FEATURES)
    assert header_end(["<?php", "", "// a", "/*", " * b", " */", "#[attr]", "x"]) == 6


def test_names_and_folders():
    assert all(map(TOOL_NAME.search, ("a/b.min.go", "b-min.rb", "x.pb.rs", "x_pb.jl", "zz_generated.a.go", "F.generated.php", "a_gen.go"))) and not any(map(TOOL_NAME.search, ("a/min.go", "generator.go", "pack.rb", "report_gen/x.go")))
    third = ("r/vendor/a/b/c.go", "r/gems/q-2.7.0/lib/x.rb", "r/lib/_vendor/t/x.go", "r/node_modules/p/dist/x.jl", "r/Godeps/_workspace/src/h/k/x.go", "r/extern/o-1.2/x.go")
    assert all(map(THIRD_PARTY.search, third)) and not any(map(THIRD_PARTY.search, ("r/src/vendors/a/b.go", "r/app/vendor_portal/x/y.go", "r/vendor.go", "r/app/models/a/b.go")))


def corpus(rng, n):
    verbs = ["load", "merge", "check", "parse", "split", "bind", "route", "trim"]
    nouns = ["order", "ledger", "harbor", "canvas", "button", "signal", "window", "packet", "river"]

    def hand():
        out = ["package main", ""]
        for _ in range(int(rng.integers(3, 9))):
            v = rng.choice(nouns, 4)
            out += [f"func {rng.choice(verbs)}{v[0].title()}({v[1]} int, {v[2]} string) error {{", f"\t// The {v[3]} must be {rng.choice(verbs)}ed before the {v[0]}."]
            out += [f"\t{rng.choice(nouns)} := {rng.choice(verbs)}{rng.choice(nouns).title()}({v[1]}, {int(rng.integers(2, 99))})" for _ in range(int(rng.integers(1, 6)))]
            out += [f"\tif {v[1]} > {int(rng.integers(2, 99))} {{", f"\t\treturn fail({v[2]})", "\t}", "\treturn nil", "}", ""]
        return "\n".join(out)

    def accessors():
        name = rng.choice(nouns).title()
        return "package gen\n\n" + "".join(f"func (m *{name}) Get{name}Field{i}() int {{\n\treturn m.f{i:03d}\n}}\n\n" for i in range(int(rng.integers(15, 60))))

    def minified():
        return "package m;func a(b,c int)int{" + "".join(f"{rng.choice(list('abcdef'))}={rng.choice(list('xyz'))}+{int(rng.integers(9))};" for _ in range(int(rng.integers(100, 400)))) + "}"

    def data():
        return "package d\n\nvar t = [\n" + "".join("  " + ", ".join(f"0x{int(x):02x}" for x in rng.integers(0, 256, 16)) + ",\n" for _ in range(40)) + "]\n"

    rows, truth = [], set()
    for i in range(n):
        kind = rng.choice(["hand"] * 14 + ["gen", "gen_lost", "min", "min_lost", "data", "vendor", "copy"])
        path = f"r{i % 9}/src/f{i}{'.min' * (kind == 'min')}.go"
        text = {"gen": accessors, "gen_lost": accessors, "min": minified, "min_lost": minified, "data": data}.get(str(kind), hand)()
        if kind == "gen":
            text = "// Code generated by tool v1. DO NOT EDIT.\n\n" + text
        if kind == "vendor":
            path = f"r{i % 9}/third_party/kit/f{i}.go"
        rows.append((path, text, i))
        if kind != "hand" and kind != "copy":
            truth.add(path)
        if kind == "copy":
            rows.append((f"r{(i + 1) % 9}/lib/g{i}.go", text.replace("\n", "\r\n"), i))
            truth |= {path, f"r{(i + 1) % 9}/lib/g{i}.go"}
    return rows, truth


def test_held_out_accuracy(spark):
    rows, truth = corpus(np.random.default_rng(8), 1400)
    df = spark.createDataFrame([*rows, *rows[:50], ("r1/src/null.go", None, 0), ("r1/src/empty.go", "", 0), ("r2/src/empty.go", "", 0)], "file_path string, file_content string, reason int").repartition(5)
    got = {r.file_path: r.reason for r in not_handwritten(df, "file_path", "file_content").collect()}
    found = set(got)
    assert len(found & truth) / len(truth) >= 0.97 and len(found & truth) / len(found) >= 0.97
    assert {"vendored", "forest"} <= set(got.values())
    assert not {"r1/src/null.go", "r1/src/empty.go"} & found


def test_without_labels_or_rows(spark):
    table = "var t = [\n" + "  0x1f, 0x2e, 0x3d, 0x4c, 0x5b, 0x6a, 0x79, 0x88,\n" * 40 + "]\n"
    df = spark.createDataFrame([("a/src/x.go", BODY), ("b/vendor/k/x.go", BODY + "x"), ("c/src/t.go", table)], "file_path string, file_content string")
    assert sorted((r.file_path, r.reason) for r in not_handwritten(df, "file_path", "file_content").collect()) == [("b/vendor/k/x.go", "vendored"), ("c/src/t.go", "data")]
    assert not_handwritten(df.limit(0), "file_path", "file_content").count() == 0


def test_long_lines_are_masked_whole():
    share, variety = FEATURES.index("pattern_share"), FEATURES.index("pattern_variety")
    rows, _ = describe("".join(f"{{{', '.join(str(i * k + 7) for k in range(150))}}},\n" for i in range(100, 104)))
    assert (rows[share], rows[variety]) == (1.0, 0.25)
    start = "call(a, b, c, d, e, f, g, h, i, j, k, l, m) "
    apart, _ = describe("".join(start + op * 400 + "\n" for op in "+-*/"))
    assert (apart[share], apart[variety]) == (0.0, 1.0)
