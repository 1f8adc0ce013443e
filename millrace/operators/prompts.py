"""Prompt texts as Column expressions. The instruction templates are a table of the caller: ``language, template``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, words

#: Marks around the parts of a prompt.
RELEVANT = ("#RELEVANT CONTEXT\n", "\n#END_OF_CONTEXT\n\n")
CURRENT_FILE = ("\n#CURRENT FILE: ", "\n#ENDFILE\n")
ARGUMENTS = ("#ARGUMENT_DEFINITIONS\n", "\n#END_OF_DEFINITIONS\n")
LSP = ("#LSP_CONTEXT\n", "#END_LSP_CONTEXT\n\n")


def fill(template: Column, values: dict[str, Column]) -> Column:
    """A template with ``{name}`` replaced by values (PRM-01); null values give ''."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return template


def standard_prompts(df: DataFrame, templates: DataFrame, generic: str, language: str, values: dict[str, Column]) -> DataFrame:
    """``df`` with column ``prompt`` from the template of its language, else the generic one (PRM-01).

    templates: ``language`` (lower case), ``template``; a row for each language.
    """
    t = templates.select(F.col("language").alias("__language"), F.col("template").alias("__template"))
    joined = df.join(t, F.lower(F.trim(F.col(language))) == F.col("__language"), "left")
    return joined.withColumn("prompt", fill(F.coalesce("__template", F.lit(generic)), values)).drop("__language", "__template")


def in_class(code: Column, class_line: Column) -> Column:
    """Code of a method inside its class, indented by four spaces (PRM-01); code without a class stays as it is."""
    indented = F.array_join(F.transform(F.split(code, "\n", -1), lambda s: F.when(s == "", s).otherwise(F.concat(F.lit("    "), s))), "\n")
    return F.when(class_line.isNull() | (F.trim(class_line) == ""), code).otherwise(F.concat(class_line, F.lit(" {\n"), indented, F.lit("\n}")))


def go_test_name(name: Column) -> Column:
    """Function name with its first letter in upper case (PRM-01)."""
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 20))


def with_examples(prompt: Column, contexts: Column, k: int | None = None) -> Column:
    """A prompt after numbered retrieved contexts (PRM-02, TOP-05); without contexts as it is."""
    some = F.coalesce(contexts if k is None else F.slice(contexts, 1, k), F.array().cast("array<string>"))
    numbered = F.transform(some, lambda c, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(":\n"), F.coalesce(c, F.lit(""))))
    return F.when(F.size(some) > 0, F.concat(F.lit(RELEVANT[0]), F.array_join(numbered, "\n\n"), F.lit(RELEVANT[1]), prompt)).otherwise(prompt)


def with_file(prompt: Column, path: Column, content: Column) -> Column:
    """A prompt after the file it is about (PRM-02)."""
    return F.concat(F.lit(CURRENT_FILE[0]), F.coalesce(path, F.lit("")), F.lit("\n"), F.coalesce(content, F.lit("")), F.lit(CURRENT_FILE[1]), prompt)


def with_definitions(prompt: Column, arguments: Column, content: Column) -> Column:
    """A prompt after the definitions of its arguments' types that the file doesn't hold already (PRM-03)."""
    texts = F.flatten(F.transform(F.coalesce(arguments, F.array()), lambda a: F.transform(F.coalesce(a["definitions"], F.array()), lambda d: d["definition"])))
    new = F.filter(texts, lambda t: t.isNotNull() & (t != "") & ~F.coalesce(F.contains(content, F.trim(t)), F.lit(False)))
    block = F.concat(F.lit(LSP[0] + ARGUMENTS[0]), F.trim(F.array_join(new, "\n")), F.lit(ARGUMENTS[1] + LSP[1]))
    return F.when(F.size(new) > 0, F.concat(block, prompt)).otherwise(prompt)


def code_identity(code: str | Column) -> Column:
    """Hash of code up to white space (DED-03)."""
    return F.md5(F.array_join(words(col(code)), " "))


def retrieval_prompt(chunks: DataFrame, query: str, order: list[str], target: str) -> DataFrame:
    """One prompt for each query from its chunks (PRM-05): chunks of other modules first, by module, those of the current file last, numbered, then the target.

    chunks: the query's key, ``module``, ``is_current``, ``text`` and the order columns; a query's chunks are few (top-k).
    """
    row = F.struct(F.col("is_current"), F.col("module"), *order, F.col("text"))
    listed = chunks.groupBy(query).agg(F.array_sort(F.collect_list(row)).alias("rows"), F.first(target).alias("__target"))
    parts = F.transform("rows", lambda r, i: F.concat(F.lit("# Chunk "), (i + 1).cast("string"), F.lit(" from "), r["module"], F.lit("\n"), r["text"]))
    return listed.select(query, F.concat(F.array_join(parts, "\n\n"), F.lit("\n\n# Target\n"), F.coalesce("__target", F.lit(""))).alias("prompt"))


def repair_prompt(prompt: Column, test: Column, log: Column) -> Column:
    """A request to repair a failing test (PRM-06), with its whole log."""
    return F.concat(prompt, F.lit("\n\nThe test below fails. Return a corrected test.\n\n#TEST\n"), F.coalesce(test, F.lit("")), F.lit("\n#END_TEST\n\n#LOG\n"), F.coalesce(log, F.lit("")), F.lit("\n#END_LOG\n"))
