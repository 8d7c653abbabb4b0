"""Small result tables as CSV, Markdown and LaTeX, and job artifacts as JSON."""

from __future__ import annotations

import csv
import hashlib
import io
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

#: Rows a rendered table may have; summaries have one for each method or type, larger results are written by Spark instead.
MOST = 10_000


def _text(v: object) -> str:
    return "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)


def _rows(df: DataFrame) -> tuple[list[str], list[list[str]]]:
    rows = df.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError("too many rows for a rendered table; write the DataFrame instead")
    return df.columns, [[_text(v) for v in r] for r in rows]


def to_csv(df: DataFrame) -> str:
    names, rows = _rows(df)
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([names, *rows])
    return out.getvalue()


def to_markdown(df: DataFrame) -> str:
    names, rows = _rows(df)
    cell = lambda t: t.replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(map(cell, r)) + " |" for r in [names, *rows]]
    return "\n".join([lines[0], "|" + " --- |" * len(names), *lines[1:]]) + "\n"


#: Columns above which a LaTeX table spans both columns of a page and is scaled to its width.
WIDE = 8


def to_latex(df: DataFrame, caption: str = "") -> str:
    names, rows = _rows(df)

    def cell(t: str) -> str:
        t = t.replace("\\", "\\textbackslash{}")
        for mark in "&%$#_":
            t = t.replace(mark, "\\" + mark)
        return t

    body = "\n".join(" & ".join(map(cell, r)) + " \\\\" for r in rows)
    head = " & ".join(map(cell, names)) + " \\\\"
    inner = f"\\begin{{tabular}}{{{'l' * len(names)}}}\n\\hline\n{head}\n\\hline\n{body}\n\\hline\n\\end{{tabular}}"
    kind = "table"
    if len(names) > WIDE:
        kind, inner = "table*", f"\\resizebox{{\\textwidth}}{{!}}{{%\n{inner}}}"
    return f"\\begin{{{kind}}}\n\\caption{{{cell(caption)}}}\n{inner}\n\\end{{{kind}}}\n"


def export(df: DataFrame, folder: str, name: str, caption: str = "") -> list[Path]:
    """The three formats side by side, from one pass over the result."""
    kept = df.sparkSession.createDataFrame(df.limit(MOST + 1).toArrow())
    out = []
    for suffix, text in (("csv", to_csv(kept)), ("md", to_markdown(kept)), ("tex", to_latex(kept, caption))):
        files.write_text(df.sparkSession, f"{folder}/{name}.{suffix}", text)
        out.append(Path(folder) / f"{name}.{suffix}")
    return out


def write_records(df: DataFrame, folder: str, *by: str) -> None:
    """Per-question records as JSON lines, a folder for each value of the given columns."""
    df.write.mode("overwrite").partitionBy(*by).json(folder) if by else df.write.mode("overwrite").json(folder)


def manifest(folder: str, **fields: object) -> Path:
    files.write_text(SparkSession.active(), f"{folder}/manifest.json", json.dumps(fields, indent=2, sort_keys=True, default=str) + "\n")
    return Path(folder) / "manifest.json"


def hypotheses(answers: DataFrame, folder: str) -> None:
    """Answers (method_name, question_id, prediction) as JSON lines of question_id and hypothesis, a folder for each method."""
    df = answers.select("method_name", "question_id", F.coalesce("prediction", F.lit("")).alias("hypothesis"))
    write_records(df, folder, "method_name")


def report(title: str, summary: DataFrame, details: DataFrame | None = None, first: tuple[str, ...] = (), notes: dict[str, object] | None = None) -> str:
    """A Markdown report: notes, the summary with the columns in `first` leading, and details if given."""
    lead = [c for c in first if c in summary.columns]
    order = summary.columns[:1] + [c for c in lead if c != summary.columns[0]] + [c for c in summary.columns[1:] if c not in lead]
    parts = [f"# {title}", "\n".join(f"- {k}: {v}" for k, v in sorted((notes or {}).items())), "## Summary", to_markdown(summary.select(*order))]
    if details is not None:
        parts += ["## Details", to_markdown(details)]
    return "\n\n".join(p.rstrip("\n") for p in parts if p) + "\n"


def split_manifest(members: DataFrame, **fields: object) -> str:
    """JSON of a split: members (split, question_id), its ids in order by split, and a digest of all of them. Ids of one evaluation set; a driver's size."""
    ids: dict[str, list[str]] = {}
    for r in members.select("split", "question_id").distinct().orderBy("split", "question_id").toLocalIterator():
        ids.setdefault(r.split, []).append(r.question_id)
    every = json.dumps(sorted(i for v in ids.values() for i in v), separators=(",", ":"))
    return json.dumps({**fields, "splits": ids, "dataset_question_ids_sha256": hashlib.sha256(every.encode()).hexdigest()}, indent=2, sort_keys=True) + "\n"
