"""Reports of small results as Markdown (SNK-08). Formatting runs on the driver, over a stated number of rows at most."""

from __future__ import annotations

from pyspark.sql import DataFrame


def text_of(value, decimals: int) -> str:
    if value is None:
        return "n/a"
    return f"{value:.{decimals}f}" if isinstance(value, float) else str(value).replace("|", "\\|").replace("\n", " ")


def markdown_table(df: DataFrame, title: str, most: int = 200, decimals: int = 2) -> str:
    """A table of up to ``most`` rows of an ordered result; says so if there are more."""
    rows = df.limit(most + 1).collect()
    out = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    out += ["| " + " | ".join(text_of(v, decimals) for v in r) + " |" for r in rows[:most]]
    return "\n".join(out + ([f"\nThe first {most} rows."] if len(rows) > most else [])) + "\n"


def comparison_paragraph(leaders: DataFrame, significant: int, tested: int) -> str:
    """One paragraph on which models lead how many settings, and how clearly (AGG-23). leaders: ``model, separated``."""
    rows = leaders.groupBy("model").agg({"*": "count", "separated": "max"}).collect()
    wins = sorted(((r["count(1)"], r["model"]) for r in rows), key=lambda x: (-x[0], x[1]))
    clear = leaders.where("separated").count()
    names = ", ".join(f"{m} ({n})" for n, m in wins) or "no model"
    return f"Leading by setting: {names}. In {clear} settings the leader's interval lies above that of the next model; {significant} of {tested} paired tests are significant after correction."
