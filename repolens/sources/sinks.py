"""Outputs: JSON and text files, padded tables, an HTML page, and the catalogue of models."""

from __future__ import annotations

import html
import json
import os
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a section that a report holds; sections are aggregates, and a larger one is written as a table.
REPORT_ROWS = 100_000


def report_rows(df: DataFrame, most: int = REPORT_ROWS) -> list[dict]:
    rows = [r[0] for r in df.limit(most + 1).select(F.to_json(F.struct("*"))).collect()]
    if len(rows) > most:
        raise ValueError(f"a section of over {most} rows belongs in a table (write_table)")
    return [json.loads(r) for r in rows]


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json(sections: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    """One pretty file per section; a failing one is reported and doesn't stop the others."""
    os.makedirs(folder, exist_ok=True)
    failed = {}
    for name, df in sections.items():
        try:
            with open(os.path.join(folder, f"{name}.json"), "w", encoding="utf-8") as f:
                json.dump(report_rows(df), f, indent=2, ensure_ascii=False)
        except Exception as e:  # noqa: BLE001  sections fail on their own
            failed[name] = str(e)
    return failed


def write_html(sections: Mapping[str, DataFrame], path: str, title: str = "Report") -> None:
    """A plain page with a table per section."""
    cell = lambda v: html.escape("" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False))
    parts = [f"<!DOCTYPE html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in sections.items():
        rows = report_rows(df)
        head = "".join(f"<th>{html.escape(c)}" for c in df.columns)
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}" + "".join("<tr>" + "".join(f"<td>{cell(r.get(c))}" for c in df.columns) for r in rows) + "</table>")
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(parts))


def write_texts(rows: DataFrame, folder: str, name: str = "name", text: str = "text") -> None:
    """One folder of text per name."""
    rows.select(F.col(name).alias("name"), F.col(text).cast("string").alias("value")).write.mode("overwrite").partitionBy("name").option("lineSep", "\n").text(folder)


def padded_table(rows: Sequence[Mapping[str, object]], columns: Sequence[str], totals: Mapping[str, object] | None = None) -> str:
    """Columns of even width, with a line of totals."""
    lines = [list(columns), *([str(r.get(c, "")) for c in columns] for r in rows)]
    if totals:
        lines.append([str(totals.get(c, "")) for c in columns])
    widths = [max(len(x[k]) for x in lines) for k in range(len(columns))]
    out = ["  ".join(v.ljust(w) for v, w in zip(line, widths)).rstrip() for line in lines]
    out.insert(1, "  ".join("-" * w for w in widths))
    if totals:
        out.insert(len(out) - 1, out[1])
    return "\n".join(out)


def model_catalogue(spark: SparkSession, manifests: Iterable[Mapping[str, object]]) -> DataFrame:
    """A row per model of each provider's manifest ({family, completions: [..], embeddings: [..]}), by family."""
    rows = [(m["family"], kind, str(x["key"]), int(x.get("maxTotalTokens", 0))) for m in manifests for kind in ("completions", "embeddings") for x in m.get(kind, ())]
    return spark.createDataFrame(rows, "family string, kind string, model string, maxTotalTokens long").orderBy("family", "kind", "model")


def isolated(sections: Mapping[str, Callable[[], DataFrame]], otherwise: Callable[[str], DataFrame]) -> dict[str, DataFrame]:
    """Data of sections; one that fails gets its default."""
    out = {}
    for name, make in sections.items():
        try:
            out[name] = make()
        except Exception:  # noqa: BLE001  sections fail on their own
            out[name] = otherwise(name)
    return out
