"""Text and path functions as Column expressions. A null text gives null, unless a function says otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a text is cut into lines besides ``\\n``: \\r\\n, \\r, vertical tab, form feed, NEL, line and paragraph separator.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
#: Beginnings of comment lines.
COMMENT_PREFIX = r"^(//|#|--|/\*|\*)"
#: Languages whose tag a fence may have.
FENCE_TAGS = ("julia", "ruby", "go", "rust", "php")
#: Words that mark a line of a log as an error.
ERROR_WORDS = ("error", "failed", "exception", "panic", "fatal")
#: Folders that a scan of sources leaves out, and the file endings that it takes.
PRUNED_FOLDERS = (".git", "node_modules", "__pycache__", ".venv", "venv", "build", "dist", "target")
SOURCE_ENDINGS = (".py", ".go", ".rs", ".jl", ".rb", ".php", ".js", ".ts", ".java", ".c", ".h", ".cpp", ".hpp", ".cs", ".kt")
#: Vendor-like folders.
VENDOR_FOLDERS = ("vendor", "vendors", "third_party", "thirdparty", "external", "deps", "node_modules", "bower_components", "gems", "pkg/mod", "site-packages", "Godeps", "bundle")


#: White space of all scripts, as Python's ``strip`` removes it.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Text without white space at its ends; Spark's ``trim`` removes spaces only."""
    return F.btrim(col(c), F.lit(WHITE))


def rstrip(c: str | Column) -> Column:
    return F.rtrim(col(c), F.lit(WHITE))


def lines(text: str | Column) -> Column:
    """Lines as Python's ``split('\\n')`` gives them: a final line end gives a last empty line."""
    return F.split(col(text), "\n", -1)


def splitlines(text: str | Column) -> Column:
    """Lines as Python's ``splitlines`` gives them: any line end, no empty last line; '' has no line."""
    text = col(text)
    parts = F.split(text, LINE_END, -1)
    last_empty = F.element_at(parts, -1) == ""
    return F.when(text == "", F.array().cast("array<string>")).when(last_empty, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def words(text: str | Column) -> Column:
    """Tokens between white space, as Python's ``split()`` gives them."""
    return F.filter(F.split(col(text), r"\s+", -1), lambda w: w != "")


def code_line_count(text: str | Column) -> Column:
    """Lines that are neither blank nor comments (FLT-02)."""
    return F.size(F.filter(lines(text), lambda line: (strip(line) != "") & ~strip(line).rlike(COMMENT_PREFIX)))


def fenced_code(text: str | Column) -> Column:
    """Contents of all closed fences with a known tag or none, joined by a blank line; '' if there are none (TXT-01)."""
    tags = "|".join(FENCE_TAGS)
    return F.array_join(F.regexp_extract_all(col(text), F.lit(rf"(?s)```(?:{tags})?\r?\n(.*?)```"), F.lit(1)), "\n\n")


def php_without_docblock(text: str | Column) -> Column:
    """PHP code without the blank and comment lines right after ``declare(strict_types=1);`` (TXT-02)."""
    return F.regexp_replace(col(text), r"(?m)^(\s*declare\(strict_types=1\);[^\n]*\n)((?:[ \t]*(?://[^\n]*|#[^\n]*|/\*[^\n]*|\*[^\n]*)?\n)+)", "$1")


def payload(text: str | Column) -> Column:
    """A response as a list of strings: null gives none, text itself (TXT-03)."""
    return F.when(col(text).isNull(), F.array().cast("array<string>")).otherwise(F.array(col(text)))


def package_name(content: str | Column, language: str | Column) -> Column:
    """Package, module or namespace of a file, from its first such line (TXT-09); '' if there is none.

    Go, Julia and Rust lines may be indented; Ruby and PHP lines may not.
    """
    content, language = col(content), F.lower(strip(col(language)))
    return (
        F.when(language == "go", F.regexp_extract(content, r"(?m)^[ \t]*package[ \t]+([A-Za-z_]\w*)", 1))
        .when(language == "julia", F.regexp_extract(content, r"(?m)^[ \t]*module[ \t]+([A-Za-z_]\w*)", 1))
        .when(language == "rust", F.regexp_extract(content, r"(?m)^[ \t]*(?:pub[ \t]+)?mod[ \t]+([A-Za-z_]\w*)", 1))
        .when(language == "ruby", F.regexp_extract(content, r"(?m)^module[ \t]+([A-Za-z_][\w:]*)", 1))
        .when(language == "php", F.regexp_extract(content, r"(?m)^namespace[ \t]+([\w\\]+)", 1))
        .otherwise("")
    )


def julia_callable(signature: str | Column) -> Column:
    """Name of a Julia callable by the first of four forms that fits (TXT-10)."""
    s = col(signature)
    forms = [r"^\s*function\s+\([^)]*::\s*([\w.]+)", r"^\s*function\s+([\w.!]+)", r"^\s*macro\s+([\w!]+)", r"^\s*([\w.!]+)\s*(?:\{[^}]*\})?\("]
    return F.coalesce(*[F.nullif(F.regexp_extract(s, p, 1), F.lit("")) for p in forms])


def relative_path(path: str | Column, repo: str | Column) -> Column:
    """The path from the segment that is the repository's name on; the path itself if it has none (TXT-12)."""
    parts = F.split(col(path), "/", -1)
    at = F.array_position(parts, col(repo))
    return F.when(at > 0, F.array_join(F.slice(parts, at.cast("int"), F.size(parts)), "/")).otherwise(col(path))


def repo_of(path: str | Column) -> Column:
    """First segment of the path (PRJ-05)."""
    return F.split(col(path), "/", -1)[0]


def repo_or_unknown(path: str | Column) -> Column:
    """First segment, or ``unknown`` for a path without a slash."""
    return F.when(F.contains(col(path), F.lit("/")), repo_of(path)).otherwise("unknown")


def safe_model_name(model: str | Column) -> Column:
    """Model name as a folder (PRJ-07)."""
    return F.translate(col(model), "/:", "__")


def mode_folder(mode: str | Column, kind: str | Column) -> Column:
    """Folder of a mode; retrieval modes carry their kind (PRJ-08)."""
    return F.when(col(kind).isNull() | (col(kind) == ""), col(mode)).otherwise(F.concat_ws("_", col(mode), col(kind)))


def option_list(text: str | Column, single: str | Column | None = None) -> Column:
    """Values of a comma-separated option and then a single one, trimmed, without empty ones, first occurrences (FLT-05)."""
    parts = F.coalesce(F.split(col(text), ",", -1), F.array().cast("array<string>"))
    if single is not None:
        parts = F.concat(parts, F.array(F.coalesce(col(single), F.lit(""))))
    return F.array_distinct(F.filter(F.transform(parts, lambda p: strip(p)), lambda p: p != ""))


def whitespace_normalised(text: str | Column) -> Column:
    """Runs of white space as one space (TXT-25)."""
    return strip(F.regexp_replace(col(text), r"\s+", " "))


def first_line(text: str | Column) -> Column:
    """The text, or its first line with `` ...`` if it has more (TXT-20)."""
    text = col(text)
    return F.when(F.contains(text, F.lit("\n")), F.concat(F.split(text, "\n", -1)[0], F.lit(" ..."))).otherwise(text)


def first_error_line(log: str | Column) -> Column:
    """First line of a log that names an error, else the first that isn't blank, trimmed, 200 characters; '' if none (TXT-21)."""
    log = F.coalesce(col(log), F.lit(""))
    trimmed = F.transform(F.split(log, "\n", -1), lambda s: strip(s))
    named = F.filter(trimmed, lambda s: F.lower(s).rlike("|".join(ERROR_WORDS)))
    return F.substring(F.coalesce(F.get(named, F.lit(0)), F.get(F.filter(trimmed, lambda s: s != ""), F.lit(0)), F.lit("")), 1, 200)


#: Line numbers in logs, by language first, then for all.
LINE_NUMBERS = {"julia": r"@.*?:(\d+)", "php": r"on line (\d+)", "ruby": r"\.rb:(\d+):"}
LINE_NUMBER_FORMS = (r"(?i)line[:\s]+(\d+)", r":(\d+):", r"(?i)at line (\d+)", r"(?i)\[line (\d+)\]")


def log_line_number(log: str | Column, language: str | Column | None = None) -> Column:
    """Line number that a log tells; null if it tells none (TXT-22)."""
    log = col(log)

    def of(pattern: str) -> Column:
        return F.regexp_extract(log, pattern, 1).try_cast("int")

    own = [F.when(col(language) == name, of(p)) for name, p in LINE_NUMBERS.items()] if language is not None else []
    return F.coalesce(*own, *[of(p) for p in LINE_NUMBER_FORMS])


def without_metadata(text: str | Column) -> Column:
    """Text without its METADATA block (TXT-23)."""
    return strip(F.regexp_replace(col(text), r"(?s)METADATA\s*=\s*\{.*?\}", ""))


def range_text(text: str | Column, start_line: Column, start_char: Column, end_line: Column, end_char: Column) -> Column:
    """Text of a 0-based range of (line, character) (TXT-24); '' if it starts after the last line, or on one that imports.

    A range within one line that ends no later than it starts gives the whole line.
    """
    parts = lines(text)
    n = F.size(parts)
    first = F.get(parts, start_line)
    trimmed = strip(first)
    imports = _any([F.startswith(trimmed, F.lit(w)) for w in ("import ", "from ", "use ")]) | (F.startswith(trimmed, F.lit('"')) & F.contains(F.substring(first, F.lit(1), start_char), F.lit("import")))
    one = F.when(end_char > start_char, F.substring(first, start_char + 1, F.greatest(end_char - start_char, F.lit(0)))).otherwise(first)
    head = F.substring(first, start_char + 1, F.length(first))
    between = F.slice(parts, start_line + 2, F.greatest(F.least(end_line - 1, n - 1) - start_line, F.lit(0)))
    tail = F.when(end_line < n, F.array(F.substring(F.get(parts, end_line), F.lit(1), end_char))).otherwise(F.array().cast("array<string>"))
    more = F.array_join(F.concat(F.array(head), between, tail), "\n")
    return F.when((start_line >= n) | imports, "").when(start_line == end_line, one).otherwise(more)


def occurrences(text: Column, part: str) -> Column:
    """Times that a part occurs in a text without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part)))) / len(part)).cast("int")


#: Weights of the operators of a condition; one within another counts for both.
CONDITION_OPERATORS = {"+": 1, "-": 1, "*": 1, "/": 1, "%": 1, "<": 1, ">": 1, "==": 1, "!=": 1, "<=": 1, ">=": 1, "&&": 2, "||": 2}
#: Words of a condition that are no identifiers.
CONSTANTS = ("true", "false", "null", "nil", "None")


def paren_depth(text: Column) -> Column:
    """Deepest nesting of round brackets."""
    steps = F.transform(F.split(text, ""), lambda c: F.when(c == "(", 1).when(c == ")", -1).otherwise(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(steps, start, lambda a, s: F.struct((a["now"] + s).alias("now"), F.greatest(a["most"], a["now"] + s).alias("most")))["most"]


def condition_complexity(condition: str | Column) -> Column:
    """Weights of a condition's operators, for each occurrence, and twice the depth of its brackets (TXT-19)."""
    c = col(condition)
    return reduce(lambda a, b: a + b, [occurrences(c, op) * weight for op, weight in CONDITION_OPERATORS.items()]) + 2 * paren_depth(c)


def condition_identifiers(condition: str | Column) -> Column:
    """Distinct words of a condition between operators, in order, without numbers and constants (TXT-19)."""
    parts = words(F.regexp_replace(col(condition), r"[()!&|<>=+\-*/%]", " "))
    return F.array_distinct(F.filter(parts, lambda n: ~n.rlike(r"^\d+$") & ~n.isin(*CONSTANTS)))


def normalised_condition(condition: str | Column, rounds: int = 4) -> Column:
    """A condition trimmed, without outer brackets and double negations, for up to ``rounds`` layers (TXT-19)."""
    c = strip(col(condition))
    for _ in range(rounds):
        c = strip(F.regexp_replace(c, r"^!\s*\(\s*!\s*\((.*)\)\s*\)$", "$1"))
        c = strip(F.regexp_replace(c, r"^!\s*!\s*", ""))
        c = F.when(c.rlike(r"^\([^()]*(?:\([^()]*\)[^()]*)*\)$"), strip(F.substring(c, F.lit(2), F.length(c) - 2))).otherwise(c)
    return c


def signature(code: str | Column, language: str | Column) -> Column:
    """Signature of a function (TXT-08): its first line that isn't blank, or the lines up to the one where its brackets close.

    A Julia short form is cut at the ``=`` after its brackets; Go and Rust lose the ``{`` at the end.
    """
    code, language = col(code), F.lower(strip(col(language)))
    body = F.regexp_replace(code, r"^(?:[ \t]*\r?\n)+", "")
    first = F.split(body, "\n", -1)[0]
    opened = F.regexp_extract(body, r"(?s)^((?:[^()\n]*)\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)[^\n]*)", 1)
    full = F.when(F.contains(first, F.lit("(")) & (opened != ""), opened).otherwise(first)
    short = F.regexp_replace(full, r"^([^(]*\((?:[^()]|\([^()]*\))*\)(?:\s*::\s*[\w{}.,]+)?)\s*=(?!=).*$", "$1")
    full = F.when((language == "julia") & ~full.rlike(r"^\s*(?:function|macro)\b"), short).otherwise(full)
    return strip(F.when(language.isin("go", "rust"), F.regexp_replace(full, r"\s*\{\s*$", "")).otherwise(full))


def without_comments(code: str | Column, language: str | Column) -> Column:
    """Code without comments (TXT-06), as naive about strings as a line split is; blank lines are left out.

    C-like and PHP: block comments, ``//`` (PHP also ``#``); Julia: ``#= =#`` and ``#``; Ruby: ``=begin ... =end`` and ``#``.
    """
    code, language = col(code), F.lower(strip(col(language)))
    block = (
        F.when(language == "julia", F.regexp_replace(code, r"(?s)#=.*?=#", ""))
        .when(language == "ruby", F.regexp_replace(code, r"(?ms)^=begin.*?^=end[^\n]*", ""))
        .otherwise(F.regexp_replace(code, r"(?s)/\*.*?\*/", ""))
    )
    mark = F.when(language.isin("julia", "ruby"), "#").when(language == "php", "(?://|#)").otherwise("//")
    stripped = F.transform(F.split(block, "\n", -1), lambda s: F.regexp_replace(s, F.concat(mark, F.lit(".*$")), F.lit("")))
    return F.array_join(F.filter(F.transform(stripped, lambda s: rstrip(s)), lambda s: strip(s) != ""), "\n")


#: Words of tests by language, by which blocks and lines of a response are told.
TEST_KEYWORDS = {
    "ruby": ("Test", "describe", "it ", "expect", "assert", "should"),
    "julia": ("@test", "@testset", "Test", "using Test"),
    "go": ("func Test", "testing.T", 'import "testing"'),
    "rust": ("#[test]", "#[cfg(test)]", "mod tests", "assert!", "assert_eq!"),
    "php": ("class Test", "function test", "PHPUnit", "assert"),
}
#: How a line of explanation begins, trimmed and in lower case.
EXPLANATION_STARTS = (r"here['s\s]", r"this\s+(?:code|test|function)", r"the\s+(?:code|test|function)", "explanation:", "note:", "example:", "usage:", r"\d+\.", r"[-*]\s")
#: What a line of code has, trimmed.
CODE_SIGNS = (r"^def\s+", r"^function\s+", r"^class\s+", r"^import\s+", r"^require\s+", r"^using\s+", r"^package\s+", r"^#\[", "^@", r"[=(){}\[\];]")
#: Fixed value: a fenced block with any tag.
ANY_FENCE = r"(?s)```\w*\s*\n(.*?)```"


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def is_explanation(line: Column) -> Column:
    """Whether a line explains code rather than being code."""
    return F.lower(strip(line)).rlike("^(?:" + "|".join(EXPLANATION_STARTS) + ")")


def has_test_keyword(text: Column, language: Column) -> Column:
    """Whether a text has a word of tests of the language; false for unknown languages."""
    return _any([(language == lang) & _any([F.contains(text, F.lit(w)) for w in words]) for lang, words in TEST_KEYWORDS.items()])


def _cleaned(parts: Column) -> Column:
    """Lines put together without explanations and white space at their ends, two blank lines in a row at most, trimmed."""
    kept = F.filter(F.transform(parts, lambda s: rstrip(s)), lambda s: ~is_explanation(s))
    return strip(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def best_block(response: str | Column, language: str | Column) -> Column:
    """Test code in a response (TXT-04); null gives ''.

    The first fenced block (any tag) with a word of tests of the language, else the longest one, the first of equals;
    without a block the lines from the first one that looks like code on. Lines that explain are left out in any case. Of an
    unknown language the longest block, else the response, both only trimmed.
    """
    r = F.coalesce(col(response), F.lit(""))
    language = F.coalesce(F.lower(F.trim(col(language))), F.lit(""))
    found = F.regexp_extract_all(r, F.lit(ANY_FENCE), F.lit(1))
    longest = F.array_max(F.transform(found, lambda b, i: F.struct(F.length(b).alias("n"), (-i).alias("i"), b.alias("b"))))["b"]
    first = F.get(F.filter(found, lambda b: has_test_keyword(b, language)), F.lit(0))
    lines_ = F.split(r, "\n", -1)
    told = F.filter(lines_, lambda s: ~is_explanation(s))
    begin = F.array_position(F.transform(told, lambda s: (strip(s) != "") & (has_test_keyword(s, language) | strip(s).rlike("|".join(CODE_SIGNS)))), True)
    raw = F.when(begin > 0, F.slice(told, F.greatest(begin, F.lit(1)).cast("int"), F.greatest(F.size(told), F.lit(1)))).otherwise(lines_)
    known = language.isin(*TEST_KEYWORDS)
    return F.when(~known, strip(F.coalesce(longest, r))).otherwise(_cleaned(F.coalesce(F.split(F.coalesce(first, longest), "\n", -1), raw)))


def test_score(code: str | Column, language: str | Column) -> Column:
    """How surely a text is test code (TXT-05): 0.6 for a word of tests of the language, 0.3 for three lines or more that aren't
    blank, 0.1 if the first line doesn't explain; 0 for blank and null code, 0.5 for other languages. From 0.5 on it is valid."""
    c = F.coalesce(col(code), F.lit(""))
    language = F.coalesce(F.lower(F.trim(col(language))), F.lit(""))
    parts = F.split(c, "\n", -1)
    long_ = F.size(F.filter(parts, lambda s: strip(s) != "")) >= 3
    points = F.when(has_test_keyword(c, language), 6).otherwise(0) + F.when(long_, 3).otherwise(0) + F.when(is_explanation(parts[0]), 0).otherwise(1)
    return F.when(strip(c) == "", 0.0).when(~language.isin(*TEST_KEYWORDS), 0.5).otherwise(points / 10.0)


def is_test_path(path: str | Column, path_parts: tuple[str, ...] = ("/tests/", "/test/", "/spec/"), name_parts: tuple[str, ...] = ("_test.", "test_", "_spec.", ".spec.", ".test.")) -> Column:
    """Whether a path is one of a test (SRC-09): path parts are looked for as they are in the lower-case path, name parts in lower case."""
    low = F.lower(col(path))
    name = F.element_at(F.split(low, "/", -1), -1)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in path_parts] + [F.contains(name, F.lit(p.lower())) for p in name_parts])


def is_source_path(path: str | Column, endings: tuple[str, ...] = SOURCE_ENDINGS, pruned: tuple[str, ...] = PRUNED_FOLDERS) -> Column:
    """Whether a scan takes a path (SRC-06): a known ending, no pruned folder."""
    p = col(path)
    folders = F.split(p, "/", -1)
    return reduce(lambda a, b: a | b, [F.endswith(F.lower(p), F.lit(e)) for e in endings]) & ~F.exists(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))), lambda f: f.isin(*pruned))


def context_lines(text: str | Column, line: Column, before: int, after: int) -> Column:
    """Lines around a 1-based line, clamped to the text (WIN-05, WIN-06); '' for a line outside it."""
    parts = lines(text)
    n = F.size(parts)
    start = F.greatest(F.lit(1), line - before)
    end = F.least(n, line + after)
    return F.when((line >= 1) & (line <= n), F.array_join(F.slice(parts, start, F.greatest(end - start + 1, F.lit(0))), "\n")).otherwise("")
