"""HTML reports over small, aggregated results."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

MAX_ROWS = 500  # a page for people; the tables hold everything


def _cell(value: object) -> str:
    return escape("Not recorded" if value is None else f"{value:.3f}" if isinstance(value, float) else str(value))


def _table(title: str, df: DataFrame) -> str:
    rows = df.limit(MAX_ROWS + 1).collect()
    more = f"<p>Only the first {MAX_ROWS} rows are shown.</p>" if len(rows) > MAX_ROWS else ""
    rows = rows[:MAX_ROWS]
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{_cell(v)}</td>" for v in r) + "</tr>" for r in rows)
    return f"<h2>{escape(title)}</h2><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>{more}"


def _bars(rows: list[tuple[str, float]]) -> str:
    top = max((v for _, v in rows), default=0) or 1
    bars = "".join(f'<text x="0" y="{20 * i + 14}">{escape(k)}</text><rect x="160" y="{20 * i + 3}" width="{300 * v / top:.1f}" height="14"/>' for i, (k, v) in enumerate(rows))
    return f'<svg width="480" height="{20 * len(rows) + 4}">{bars}</svg>'


def _page(title: str, *parts: str) -> str:
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>{"".join(parts)}</body></html>'


def supervisory(title: str, risk: DataFrame, trends: DataFrame, findings: DataFrame) -> str:
    """Risk bars and tables of entities, trends and findings. Everything shown is escaped."""
    bars = _bars([(r["cse_id"], float(r["risk"])) for r in risk.limit(MAX_ROWS).collect()])
    return _page(title, bars, _table("Entities", risk), _table("Trends", trends), _table("Findings", findings))


def interventions(title: str, report: DataFrame, unsupported: DataFrame | None = None) -> str:
    """Preliminary and confirmed estimates apart, what has too little to go by, and the types that none is made for."""
    parts = [_table(name.capitalize(), report.where(f"level = '{name}' and sufficient")) for name in ("preliminary", "confirmed")]
    parts.append(_table("Insufficient", report.where("not sufficient")))
    return _page(title, *parts, *([_table("Unsupported types", unsupported)] if unsupported is not None else []))
