"""Scorecards as HTML."""

from __future__ import annotations

import html
from collections.abc import Sequence

from pyspark.sql import DataFrame

from vigilark.operators.validation import in_report_order

#: Rows a report may have.
MAX_ROWS = 5_000


def _shade(v: float, top: float) -> str:
    """White to red, the top of the scale 1.3 times the largest value of the row."""
    share = 0 if top <= 0 else max(0.0, min(1.0, v / (1.3 * top)))
    fade = round(255 * (1 - share))
    return f"rgb(255,{fade},{fade})"


def _bars(values: Sequence[float]) -> str:
    top = max(values, default=0) or 1
    w = 6
    bars = "".join(f'<rect x="{i * (w + 2)}" y="{20 - 18 * v / top:.1f}" width="{w}" height="{18 * v / top:.1f}"/>' for i, v in enumerate(values))
    return f'<svg width="{len(values) * (w + 2)}" height="20">{bars}</svg>'


def scorecard_html(table: DataFrame, groups: Sequence[str], title: str, bars: bool = True) -> str:
    """A page with the scorecard of summary_by_group: one row per check, shaded by value, headers as section rows, trend bars at the end."""
    rows = in_report_order(table).limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"a report has at most {MAX_ROWS} rows")
    out = [f"<html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h2>{html.escape(title)}</h2><table><tr><th></th>"]
    out += [f"<th>{html.escape(g)}</th>" for g in groups] + (["<th>Trend</th>"] if bars else []) + ["</tr>"]
    for r in rows:
        if r["header_text"]:
            out.append(f"<tr><th colspan='{len(groups) + 1 + bars}'>{html.escape(r['header_text'])}</th></tr>")
        v = [float(r[g] or 0) for g in groups]
        cells = "".join(f"<td style='background:{_shade(x, max(v, default=0))}'>{x:,.0f}</td>" for x in v)
        out.append(f"<tr><td>{html.escape(r['column_name'])}</td>{cells}" + (f"<td>{_bars(v)}</td>" if bars else "") + "</tr>")
    return "".join(out) + "</table></body></html>"
