"""Test code and its surroundings as Column expressions: calls, names, files to run, mutants, tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, fenced_code, payload

#: Parts of the lower-case path of a test (FLT-12).
TEST_PATH_PARTS = ("test/", "tests/", "_test.", "test_", "spec/", "_spec.")
#: Kinds of tokens whose definition, and whose uses, help to write a test.
DEFINITION_KINDS = ("function", "method", "type", "class", "struct", "interface")
REFERENCE_KINDS = ("function", "method")


def invokes(code: str | Column, name: str | Column) -> Column:
    """Whether code calls a function (INV-01): its name as a word before an opening bracket.

    Without a parse, a call in a comment or string counts, too, and a Ruby call without brackets doesn't.
    """
    escaped = F.regexp_replace(col(name), r"([\\.\[\]{}()*+?^$|!])", r"\\$1")
    return F.coalesce(F.regexp_like(col(code), F.concat(F.lit(r"(?<![\w])"), escaped, F.lit(r"\s*(?:::<[^>]*>)?\("))), F.lit(False))


def go_test_names(code: str | Column) -> Column:
    """Names of a file's Go tests, in order (INV-02)."""
    return F.regexp_extract_all(col(code), F.lit(r"(?m)^func\s+(Test\w*)\s*\("), F.lit(1))


def go_run_pattern(code: str | Column) -> Column:
    """Pattern that runs exactly a file's Go tests; '' if it has none (INV-02)."""
    names = go_test_names(code)
    return F.when(F.size(names) > 0, F.concat(F.lit("^("), F.array_join(names, "|"), F.lit(")$"))).otherwise("")


def rust_test_module(code: str | Column, name: str = "tests_generated") -> Column:
    """Rust tests with their first test module renamed, so that a run can filter by it (EXE-04)."""
    c = col(code)
    first = F.regexp_extract(c, r"(?i)mod\s+(tests?_\w+|tests?)\b", 0)
    at = F.instr(c, first)
    return F.when(first == "", c).otherwise(F.concat(F.substring(c, F.lit(1), at - 1), F.lit(f"mod {name}"), F.substring(c, at + F.length(first), F.length(c))))


def julia_test_set(code: str | Column, name: str | Column) -> Column:
    """Julia tests inside a test set, unless they begin with one (EXE-04)."""
    c = col(code)
    return F.when(F.startswith(F.ltrim(c), F.lit("@testset")), c).otherwise(F.concat(F.lit('\n@testset "'), col(name), F.lit(' Tests" begin\n'), c, F.lit("\nend\n")))


def ruby_requires(code: str | Column) -> Column:
    """Ruby tests whose relative requires go up one folder only (EXE-04)."""
    return F.regexp_replace(col(code), r"require_relative\s+['\"](?:\.\./)+(?:\.\./)+", "require_relative '../")


def php_test_file(code: str | Column, autoload: str = "require_once __DIR__ . '/../vendor/autoload.php';") -> Column:
    """PHP tests with an opening tag, without imports of single names, and with one autoload line in its place (EXE-04):
    after the tag, a declaration of strict types and the namespace."""
    c = F.regexp_replace(F.coalesce(col(code), F.lit("")), "^\ufeff+", "")
    c = F.when(F.contains(c, F.lit("<?php")), c).otherwise(F.concat(F.lit("<?php\n"), c))
    c = F.regexp_replace(c, r"(?m)^\s*require(?:_once)?\b.*autoload\.php.*;\s*$", "")
    c = F.regexp_replace(c, r"(?m)^\s*use\s+[A-Za-z_]\w*\s*;\s*$", "")
    head = r"^([\s\S]*?<\?php[^\n]*\n(?:[ \t]*\n)*(?:[ \t]*declare\s*\(\s*strict_types\s*=\s*1\s*\)\s*;[^\n]*\n(?:[ \t]*\n)*)?(?:[ \t]*namespace\s[^\n]*\n(?:[ \t]*\n)*)?)"
    return F.regexp_replace(c, head, "$1" + autoload.replace("$", "\\$") + "\n")


def extracted_tests(response: str | Column, most: int = 10) -> Column:
    """Up to ``most`` tests of a response: its fenced code, else the response as it is (TOP-07)."""
    code = fenced_code(response)
    return F.slice(F.when(F.coalesce(code, F.lit("")) == "", payload(response)).otherwise(F.array(code)), 1, most)


def without_spans(content: str | Column, spans: str | Column) -> Column:
    """Text without half-open character spans ``array<struct<start, end>>`` (PRM-04); overlapping spans count once."""
    ordered = F.array_sort(F.transform(F.coalesce(col(spans), F.array().cast("array<struct<start:int,end:int>>")), lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    c = col(content)
    kept = F.aggregate(
        ordered, start, lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["text"], F.substring(c, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))).alias("text"))
    )
    return F.concat(kept["text"], F.substring(c, kept["at"] + 1, F.length(c)))


def focal_mutants(mutants: str | Column, start: Column, end: Column, name: Column) -> Column:
    """Mutants (``line, method, status``) of the focal function (FLT-13): by its lines, else by its name, alone or after ``::``."""
    m = col(mutants)
    by_line = F.filter(m, lambda x: x["line"].between(start, end))
    low = F.lower(name)
    by_name = F.filter(m, lambda x: (F.lower(x["method"]) == low) | F.endswith(F.lower(x["method"]), F.concat(F.lit("::"), low)))
    return F.when(start.isNotNull() & end.isNotNull(), by_line).when(name.isNotNull() & (name != ""), by_name).otherwise(m)


def is_test_reference(path: str | Column) -> Column:
    """Whether a reference lies in a test (FLT-12)."""
    low = F.lower(col(path))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in TEST_PATH_PARTS])


def references(found: str | Column, most: int = 3) -> Column:
    """The first references (``path, code``) outside tests (TOP-06)."""
    return F.slice(F.filter(col(found), lambda r: ~is_test_reference(r["path"])), 1, most)


def definition_helps(kind: str | Column, word: str | Column, conditions: Column | None = None) -> Column:
    """Whether a token's definition helps (FLT-11). With the words of a function's conditions only functions and methods,
    and other known kinds that occur in one, but never classes."""
    k = F.lower(col(kind))
    known = k.isin(*DEFINITION_KINDS)
    if conditions is None:
        return known
    return F.when(k.isin("function", "method"), True).when(k == "class", False).otherwise(known & F.coalesce(F.array_contains(conditions, col(word)), F.lit(False)))


def references_help(kind: str | Column, conditions: Column | None = None) -> Column:
    """Whether a token's uses help (FLT-11); never, where conditions decide."""
    return F.lower(col(kind)).isin(*REFERENCE_KINDS) if conditions is None else F.lit(False)


def condition_words(conditions: str | Column) -> Column:
    """Distinct words of a list of conditions, without numbers (FLT-11)."""
    text = F.regexp_replace(F.array_join(col(conditions), " "), r"[^A-Za-z0-9_\s]", " ")
    return F.array_distinct(F.filter(F.split(text, r"\s+", -1), lambda w: (w != "") & ~w.rlike(r"^\d+$")))


def token_summary(tokens: str | Column, most: int = 10) -> Column:
    """Counts of tokens (``word, type, definition, references``) and their first key types and functions by name (AGG-20, ENR-01)."""
    t = F.coalesce(col(tokens), F.array())

    def names(*kinds: str) -> Column:
        return F.slice(F.array_sort(F.array_distinct(F.transform(F.filter(t, lambda x: x["type"].isin(*kinds) & x["definition"].isNotNull()), lambda x: x["word"]))), 1, most)

    return F.struct(
        F.size(t).alias("total_tokens"), F.size(F.filter(t, lambda x: x["definition"].isNotNull())).alias("tokens_with_definitions"), F.size(F.filter(t, lambda x: x["references"].isNotNull())).alias("tokens_with_references"),
        names("type", "class", "struct", "interface").alias("key_types"), names("function", "method").alias("key_functions"),
    )


def replace_segment(path: str | Column, old: str, new: str) -> Column:
    """Path with each segment that is ``old`` replaced (TXT-26)."""
    return F.array_join(F.transform(F.split(col(path), "/", -1), lambda s: F.when(s == old, F.lit(new)).otherwise(s)), "/")


def perplexity(loss: str | Column) -> Column:
    """Perplexity of a mean loss that a model gave (PPL-01); null for null."""
    return F.exp(col(loss))
