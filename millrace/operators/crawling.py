"""Filters of crawled functions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import VENDOR_FOLDERS, code_line_count, col


@dataclass(frozen=True)
class FilterRules:
    """Rules of a language; those of a repository replace them key by key, so an empty list there turns a rule off."""

    min_lines: int = 20
    max_lines: int = 50
    source_roots: tuple[str, ...] = ()
    exclude_path_contains: tuple[str, ...] = ()
    exclude_functions: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    exclude_prefixes: tuple[str, ...] = ("_", "$")
    vendor_folders: tuple[str, ...] = field(default=VENDOR_FOLDERS)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def rejection(path: str | Column, name: str | Column, code: str | Column, language: str | Column, rules: FilterRules = FilterRules()) -> Column:
    """The first rule that rejects a function, in the order of the cascade, or null (FLT-01).

    ``return`` is looked for as a word, which also finds it in comments; whether the code parses is left to the parser.
    """
    path, name, code, language = F.coalesce(col(path), F.lit("")), F.coalesce(col(name), F.lit("")), F.coalesce(col(code), F.lit("")), F.lower(F.trim(col(language)))
    parts = F.split(path, "/", -1)
    folders = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    n = code_line_count(code)
    low = F.lower(name)
    checks: list[tuple[str, Column]] = [
        ("vendor_folder", _any([F.contains(path, F.lit(f"/{v}/")) for v in rules.vendor_folders])),
        ("vendor_prefix", _any([F.startswith(path, F.lit(f"{v}/")) for v in rules.vendor_folders])),
        ("source_root", ~F.exists(folders, lambda f: f.isin(*rules.source_roots)) if rules.source_roots else F.lit(False)),
        ("path", _any([F.contains(path, F.lit(p)) for p in rules.exclude_path_contains])),
        ("ruby_test", (language == "ruby") & (F.contains(path, F.lit("test/")) | F.contains(path, F.lit("spec/")))),
        ("php_test", (language == "php") & (F.contains(path, F.lit("test/")) | code.rlike(r"\b(?:protected|private|abstract)\s+(?:static\s+)?function\b"))),
        ("name", name.isin(*rules.exclude_functions) if rules.exclude_functions else F.lit(False)),
        ("name_part", _any([F.contains(low, F.lit(p.lower())) for p in rules.exclude_patterns])),
        ("name_prefix", _any([F.startswith(name, F.lit(p)) for p in rules.exclude_prefixes])),
        ("accessor", name.rlike(r"^[gs]et[A-Z]")),
        ("line_count", ~n.between(rules.min_lines, rules.max_lines)),
        ("no_return", ~code.rlike(r"\breturn\b")),
    ]
    return F.coalesce(*[F.when(test, label) for label, test in checks])


def keep_functions(df: DataFrame, path: str, name: str, code: str, language: str, rules: FilterRules = FilterRules(), by_repo: dict[str, FilterRules] | None = None) -> DataFrame:
    """Functions that no rule rejects; repositories (any case) may have rules of their own."""
    reason = rejection(path, name, code, language, rules)
    for repo, own in (by_repo or {}).items():
        reason = F.when(F.lower(F.split(F.col(path), "/", -1)[0]) == repo.lower(), rejection(path, name, code, language, own)).otherwise(reason)
    return df.where(reason.isNull())


def without_listed_tokens(tokens: DataFrame, listed: DataFrame, keywords: DataFrame) -> DataFrame:
    """Tokens (``language, word``) that aren't listed (``language, word``), nor keywords in any case (FLT-10): two anti joins."""
    kept = tokens.join(listed.select("language", "word").distinct(), ["language", "word"], "left_anti")
    k = keywords.select("language", F.lower("word").alias("__w")).distinct()
    return kept.withColumn("__w", F.lower("word")).join(k, ["language", "__w"], "left_anti").drop("__w")


#: Characters from which on a function is too large to be enriched.
TOO_LARGE = 10_000


def too_large(code: str | Column, most: int = TOO_LARGE) -> Column:
    """Whether a function has more than ``most`` characters (FLT-16); null code hasn't."""
    return F.coalesce(F.length(col(code)) > most, F.lit(False))


def prompt_columns(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Only the columns that prompts are made of (PRJ-01), as far as the table has them, so a scan reads no others."""
    wanted = ["task_id", "repo", "function_name", "focal_code", "file_path", "file_content", "language", "function_component", *(extra or [])]
    return df.select(*[c for c in dict.fromkeys(wanted) if c in df.columns])


def without_prompt(df: DataFrame) -> DataFrame:
    """Responses without their prompt (PRJ-02)."""
    return df.drop("prompt")
