"""Rule tables that sort failed tests into an error taxonomy, and their evaluation as one Column.

A rule holds for a language and a stage (``compile``: compilation failed; ``test``: it compiled but failed; ``pass``: it
passed), and gives a category and a confidence if any of its patterns occurs. Rules are tried in the order of the table.
Patterns match without regard to case, within lines.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, first_error_line

#: The categories.
SYNTAX, TYPES, API, LOGIC, DESIGN = "syntactic_compilation", "type_system_memory", "api_hallucination", "logic_assertion", "test_design_mocking"
#: Texts of shared rules.
UNDEFINED = ["undefined", "not defined", "not found", "cannot find", "does not exist", "unresolved"]
ASSERTION = ["assertion failed", "expected", "actual", "assert", "mismatch", "should equal", "should be", "to eq", "to equal"]


@dataclass(frozen=True)
class Rule:
    languages: tuple[str, ...]
    stages: tuple[str, ...]
    category: str
    confidence: float
    patterns: tuple[str, ...] = ()
    also: tuple[str, ...] = ()  # of these, one must occur, too
    on_code: bool = False
    codes: tuple[str, ...] = ()  # instead of patterns: the first error code of the log is one of these
    first_line: tuple[str, ...] = ()  # of these, one must occur in the first error line

    @property
    def pattern(self) -> str:
        return "(?i)" + "|".join(f"(?:{p})" for p in self.patterns)


#: Fixed value: where a log of Rust has an error code.
ERROR_CODE = r"error\[(E\d+)\]"
#: Error codes of Rust by kind.
RUST_BORROW = ("E0382", "E0502", "E0499", "E0503", "E0505", "E0596")
RUST_LIFETIME = ("E0106", "E0621", "E0623")
RUST_TYPES = ("E0308", "E0277", "E0282", "E0283", "E0369", "E0061", "E0063")
RUST_MEMORY = ("E0507", "E0594")
RUST_UNDEFINED = ("E0425", "E0412", "E0433", "E0432", "E0599", "E0609")
RUST_SYNTAX = ("E0423", "E0424", "E0426", "E0428")

#: Texts of a panic in Go.
GO_PANIC = ("panic:", "runtime error:", "nil pointer dereference", "index out of range", "send on closed channel", "receive on closed channel", "goroutine.*panic")

_GO, _RS, _JL, _PHP, _RB = ("go",), ("rust",), ("julia",), ("php",), ("ruby",)
_C, _T, _P = ("compile",), ("test",), ("pass",)

#: The rules, in order, by language and stage.
RULES: list[Rule] = [
    # Go, compilation failed: unknown names, then types, then syntax
    Rule(_GO, _C, API, 0.85, ("undefined:", "not defined", "undeclared name"), first_line=("undefined", "not defined", "undeclared")),
    Rule(_GO, _C, API, 0.90, ("cannot find package", "no required module")),
    Rule(_GO, _C, API, 0.80, ("cannot refer to unexported", "unexported field")),
    Rule(_GO, _C, API, 0.75, tuple(UNDEFINED)),
    Rule(_GO, _C, TYPES, 0.95, ("cannot use.*as.*in", "cannot convert", "type.*is not an expression", "invalid operation", "mismatched types")),
    Rule(_GO, _C, TYPES, 0.90, ("does not implement", "missing method", "interface conversion")),
    Rule(_GO, _C, SYNTAX, 0.90, ("syntax error", "expected.*found", "unexpected.*at end", "missing")),
    Rule(_GO, _C, SYNTAX, 0.70, ("build failed",)),
    # Go, test failed
    Rule(_GO, _T, TYPES, 0.80, ("cannot use.*as.*in", "cannot convert", "type.*is not an expression", "invalid operation", "mismatched types")),
    Rule(_GO, _T, TYPES, 0.90, ("does not implement", "missing method", "interface conversion")),
    Rule(_GO, _T, TYPES, 0.85, GO_PANIC, ("type", "interface")),
    Rule(_GO, _T, LOGIC, 0.90, ("FAIL:", "--- FAIL:", "test.*failed")),
    Rule(_GO, _T, LOGIC, 0.85, GO_PANIC, first_line=tuple(ASSERTION)),
    Rule(_GO, _T, LOGIC, 0.80, tuple(ASSERTION)),
    Rule(_GO, _P, DESIGN, 0.50, ('if.*!=.*"hardcoded"', r"t\.Errorf.*expected.*123"), on_code=True),
    # Rust
    Rule(_RS, _C, API, 0.85, codes=RUST_UNDEFINED),
    Rule(_RS, _C, API, 0.80, ("unresolved import", "failed to resolve", "no.*in scope")),
    Rule(_RS, _C, API, 0.75, tuple(UNDEFINED)),
    Rule(_RS, _C, TYPES, 0.95, codes=RUST_BORROW + RUST_LIFETIME + RUST_TYPES + RUST_MEMORY),
    Rule(_RS, _C, TYPES, 0.90, ("borrow of moved value", "cannot borrow.*as mutable", "use of moved value", "cannot move out of", "lifetime.*required", "missing lifetime specifier", "explicit lifetime")),
    Rule(_RS, _C, TYPES, 0.85, ("mismatched types", "expected.*found", "trait.*not implemented", "type annotations? (?:needed|required)")),
    Rule(_RS, _C, SYNTAX, 0.95, codes=RUST_SYNTAX),
    Rule(_RS, _C, SYNTAX, 0.85, ("unexpected token", "expected.*found", "parse error", "syntax error", "macro.*not found", "cannot find macro")),
    Rule(_RS, _T, TYPES, 0.80, codes=RUST_BORROW + RUST_LIFETIME + RUST_TYPES + RUST_MEMORY),
    Rule(_RS, _T, TYPES, 0.90, ("borrow of moved value", "cannot borrow.*as mutable", "use of moved value", "cannot move out of", "lifetime.*required", "missing lifetime specifier", "explicit lifetime")),
    Rule(_RS, _T, TYPES, 0.85, ("mismatched types", "expected.*found", "trait.*not implemented", "type annotations? (?:needed|required)")),
    Rule(_RS, _T, LOGIC, 0.90, ("assertion failed", "assert_eq!", "assert!")),
    Rule(_RS, _T, LOGIC, 0.85, ("thread.*panicked", "panic"), tuple(ASSERTION)),
    Rule(_RS, _T, LOGIC, 0.70, ("test failed", "test result: FAILED")),
    Rule(_RS, _P, DESIGN, 0.50, (r'assert_eq!\([^,]+,\s*"hardcoded"', r"assert_eq!\([^,]+,\s*123\)"), on_code=True),
    # Julia: a failed compilation is one of syntax
    Rule(_JL, _C, SYNTAX, 0.95, ("syntax:", "ParseError", "unexpected.*in input")),
    Rule(_JL, _C, SYNTAX, 0.90, ("LoadError",), ("syntax",)),
    Rule(_JL, _T, API, 0.85, ("UndefVarError:", "not defined")),
    Rule(_JL, _T, API, 0.75, ("no method matching",)),
    Rule(_JL, _T, API, 0.70, tuple(UNDEFINED)),
    Rule(_JL, _T, TYPES, 0.80, ("TypeError:", "type.*has no field", "cannot convert", "BoundsError:", "InexactError:", "DivideError:")),
    Rule(_JL, _T, TYPES, 0.85, ("MethodError:",)),
    Rule(_JL, _T, TYPES, 0.75, ("ArgumentError:", "DimensionMismatch")),
    Rule(_JL, _T, LOGIC, 0.90, ("Test Failed", "@test", "fail.*=.*[1-9]")),
    Rule(_JL, _T, LOGIC, 0.80, tuple(ASSERTION)),
    # PHP
    Rule(_PHP, _C, SYNTAX, 0.95, ("Parse error:", "syntax error", "unexpected.*expecting", "parse error")),
    Rule(_PHP, _C, SYNTAX, 0.90, (r"\A\s*Compilation error:",), ("Fatal error:",)),
    Rule(
        _PHP, _T, API, 0.90,
        ("BadMethodCallException", "UnknownSetterException", "UnknownGetterException", "UnknownMethodException", "Error:.*Call to undefined method", "NoMethodError", "Namespace declaration statement", "declare.*must be the very first", "strict_types declaration"),
    ),
    Rule(_PHP, _T, API, 0.85, ("Error:.*Undefined property", "Error:.*Attempt to read property", "property.*does not exist", "must not be accessed before initialization")),
    Rule(_PHP, _T, API, 0.90, ("Call to undefined (?:function|method)", "Undefined (?:variable|constant|class)", "Class.*not found", "Namespace.*not found", "Trait.*not found")),
    Rule(_PHP, _T, API, 0.85, ("failed to open stream", "include.*failed", "require.*failed")),
    Rule(_PHP, _T, API, 0.75, tuple(UNDEFINED)),
    Rule(_PHP, _T, TYPES, 0.80, ("TypeError:", "Argument.*must be.*given", "Return value.*must be")),
    Rule(_PHP, _T, LOGIC, 0.90, ("FAILURES!", "Failed asserting", "Tests:.*Failures:.*[1-9]", "Tests:.*Assertions:")),
    Rule(_PHP, _T, LOGIC, 0.85, (*ASSERTION, "Failed asserting", "FAILURES")),
    Rule(_PHP, _T, LOGIC, 0.60, ("ERRORS!", r"There (?:was|were) \d+ errors?:")),
    # Ruby
    Rule(_RB, _C, SYNTAX, 0.95, ("SyntaxError:", "syntax error", "unexpected.*expecting")),
    Rule(_RB, _T, API, 0.90, ("NameError:", "undefined (?:local variable|method)", "uninitialized constant", "NoMethodError:")),
    Rule(_RB, _T, API, 0.85, ("LoadError:", "cannot load such file")),
    Rule(_RB, _T, API, 0.80, ("Gem::.*Error", "Could not find gem")),
    Rule(_RB, _T, API, 0.75, tuple(UNDEFINED)),
    Rule(_RB, _T, TYPES, 0.75, ("TypeError:", "wrong number of arguments", "no implicit conversion", "IndexError:", "ZeroDivisionError:")),
    Rule(_RB, _T, LOGIC, 0.90, ("expected.*to eq", "expected.*got", "Failures:", r"\d+ example.*\d+ failure", "Expected.*but was", r"\d+ tests.*\d+ failures")),
    Rule(_RB, _T, LOGIC, 0.80, (*ASSERTION, "Failures")),
]
#: Languages whose failed tests without any log and without a match count as no error.
SILENT_WITHOUT_LOG = ("julia", "php", "ruby")


def classify(language: str | Column, log: str | Column, test_code: str | Column, check: Column, coverage_stat: Column, rules: list[Rule] = RULES) -> Column:
    """``struct(category, confidence)`` of a test; null where it has no error (ERR-01 to ERR-08).

    First tests that were never extracted, then the rules of the stage, then its fallback; a passing test is judged by its
    covered lines (none, or one for Ruby, means that it doesn't run the function), then by its code.
    """
    language = F.lower(F.trim(col(language)))
    text, code = F.coalesce(col(log), F.lit("")), F.coalesce(col(test_code), F.lit(""))
    compiled, passed = F.coalesce(check["compilation"], F.lit(False)), F.coalesce(check["tests"], F.lit(False))
    stage = F.when(~compiled, "compile").when(~passed, "test").otherwise("pass")

    def result(category: str, confidence: float) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(confidence).alias("confidence"))

    low, error_line = F.lower(text), F.lower(first_error_line(log))
    out = F.when(F.contains(low, F.lit("preprocessing")) & F.contains(low, F.lit("no tests generated")), result(SYNTAX, 0.85))
    out = out.when((code == "") | ((text == "") & check.isNull()), result(SYNTAX, 0.80))
    least = F.when(language == "ruby", 1).otherwise(0)
    out = out.when((stage == "pass") & F.coalesce(check["coverage"], F.lit(False)) & (coverage_stat["covered_lines"] <= least), result(DESIGN, 0.65))
    for r in rules:
        hit = F.regexp_extract(text, ERROR_CODE, 1).isin(*r.codes) if r.codes else (code if r.on_code else text).rlike(r.pattern)
        if r.also:
            hit = hit & text.rlike("(?i)" + "|".join(f"(?:{p})" for p in r.also))
        if r.first_line:
            hit = hit & reduce(lambda a, b: a | b, [F.contains(error_line, F.lit(w)) for w in r.first_line])
        out = out.when(language.isin(*r.languages) & stage.isin(*r.stages) & hit, result(r.category, r.confidence))
    out = out.when((stage == "compile") & (text != ""), result(SYNTAX, 0.5)).when(stage == "compile", result(SYNTAX, 0.3))
    return out.when((stage == "test") & ((text != "") | ~language.isin(*SILENT_WITHOUT_LOG)), result(LOGIC, 0.5))


#: Kinds of made-up interfaces with their confidence, and the patterns of all languages.
API_KINDS = {"phantom_library": 0.90, "signature_mismatch": 0.80, "nonexistent_api": 0.85}
API_PATTERNS = {
    "phantom_library": [
        "cannot find package", "no required module", "failed to resolve.*import", "unresolved import", "could not (?:find|load|import) (?:module|package)", "(?:class|interface|trait).*not found",
        "cannot load such file", "is not in goroot", r"error\[e0433\]", r"error\[e0432\]", "can't find crate", "package .* not found", "failed opening required", "class or interface.*does not exist",
        "unknownclassorinterfaceexception", "phpunit not found", "an error occurred while loading", "uninitialized constant.*::",
    ],
    "signature_mismatch": [
        "wrong number of arguments", r"expected \d+ arguments?, (?:got|found) \d+", "too (?:few|many) arguments", "cannot use .* as type", "no method matching", "methoderror.*argument", "mismatched types", "type mismatch",
        "expects parameter", "argumenterror", "not enough arguments", "cannot convert", r"error\[e0308\]", r"error\[e0061\]", r"this function takes \d+ argument", r"expects (?:at least|at most|exactly) \d+ parameter", r"missing argument \d+",
    ],
    "nonexistent_api": [
        "undefined:", "not defined", "undeclared name", "cannot find (?:value|function|method|type)", "call to undefined (?:function|method)", "nomethoderror", "nameerror", "undefvarerror", "undefined variable",
        "undefined (?:property|attribute)", "(?:property|attribute).*does not exist", "has no field or method", "not declared", r"error\[e0425\]", r"error\[e0412\]", r"error\[e0422\]", r"error\[e0599\]", r"error\[e0609\]",
        "undefined reference", "undefined (?:variable|constant)", "unknown(?:setter|getter)exception", "method .* does not exist", "undefined (?:local variable|method)",
    ],
}


def api_kind(message: str | Column, log: str | Column) -> Column:
    """``struct(kind, confidence)`` of a made-up interface (ERR-09): the first kind with a pattern in the lower-case text, else ``other``."""
    text = F.lower(F.concat(F.coalesce(col(message), F.lit("")), F.lit("\n"), F.coalesce(col(log), F.lit(""))))
    out = None
    for kind, confidence in API_KINDS.items():
        value = F.struct(F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"))
        hit = text.rlike("|".join(f"(?:{p})" for p in API_PATTERNS[kind]))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.struct(F.lit("other").alias("kind"), F.lit(0.5).alias("confidence")))


__all__ = ["API", "DESIGN", "LOGIC", "RULES", "SYNTAX", "TYPES", "Rule", "api_kind", "classify", "first_error_line"]
