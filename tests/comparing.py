"""Comparison of a Spark result with that of SQL: column names, number of rows, and values in any order."""

import math


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return str(value)


def same(spark_df, result):
    columns = sorted(spark_df.columns)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    ours = sorted((tuple(map(plain, r)) for r in spark_df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    order = [names.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)
    assert len(ours) == len(theirs)
    assert ours == theirs
