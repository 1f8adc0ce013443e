"""Identifiers and outcomes of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, strip

#: Beginnings of a response that is an error, and what stands for an empty one.
ERROR_PREFIX = r"^(Error|Exception|\[ERROR:)"
EMPTY_ERROR = "Empty response from model"


def blank(c: str | Column) -> Column:
    """Whether a text has white space of any script only; null counts as blank."""
    return F.coalesce(col(c), F.lit("")).rlike(r"(?U)^\s*$")


def task_number(task_id: str | Column) -> Column:
    """The id as an integer if it is one (IDS-01): ``" 007 "`` is 7; else null."""
    return strip(col(task_id).cast("string")).try_cast("bigint")


def task_key(task_id: str | Column) -> Column:
    """Canonical text of an id: the integer, else the trimmed text; null and blank are ``unknown``."""
    return F.coalesce(task_number(task_id).cast("string"), F.nullif(strip(col(task_id).cast("string")), F.lit("")), F.lit("unknown"))


def task_order(task_id: str | Column) -> list[Column]:
    """Sort keys (SRT-01): integers by value, then texts; null sorts as '' among the texts."""
    number = task_number(task_id)
    return [F.when(number.isNotNull(), 0).otherwise(1), number, F.coalesce(col(task_id).cast("string"), F.lit(""))]


def stable_id(path: str | Column, name: str | Column, start: str | Column, end: str | Column) -> Column:
    """``rag:`` and the SHA-1 of the compact JSON array of path, name, start and end (IDS-02); nulls print ``null``."""

    def text(c: Column) -> Column:
        quoted = F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"})
        return F.regexp_extract(quoted, r'(?s)^\{"x":(.*)\}$', 1)

    def number(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit("null"))

    array = F.concat(F.lit("["), text(col(path)), F.lit(","), text(col(name)), F.lit(","), number(col(start)), F.lit(","), number(col(end)), F.lit("]"))
    return F.concat(F.lit("rag:"), F.sha1(array))


def test_key(path: str | Column, name: str | Column, position: str | Column) -> Column:
    """``path::name[position]`` (IDS-03)."""
    return F.concat(col(path), F.lit("::"), col(name), F.lit("["), col(position).cast("string"), F.lit("]"))


def response_status(response: str | Column) -> Column:
    """``success`` or ``error`` of a response alone (STS-01): blank and null are errors, and so is one that begins like one."""
    r = F.coalesce(col(response), F.lit(""))
    return F.when(blank(r), "error").when(r.rlike(ERROR_PREFIX), "error").otherwise("success")


def response_error(response: str | Column) -> Column:
    """The error text that goes with ``response_status``; null for a success."""
    r = F.coalesce(col(response), F.lit(""))
    return F.when(blank(r), EMPTY_ERROR).when(r.rlike(ERROR_PREFIX), r)


def record_succeeded(status: str | Column, response: str | Column) -> Column:
    """Whether a record holds a usable answer (STS-02): its status isn't another than success, and its response isn't an error."""
    s = F.lower(F.trim(col(status)))
    return (s.isNull() | (s == "") | (s == "success")) & (response_status(response) == "success")
