"""Evaluation reports as JSON and as lines."""

from __future__ import annotations

import json
import math
from pathlib import Path


def json_value(x):
    """NaN and infinities have no JSON number: null."""
    if isinstance(x, float) and not math.isfinite(x):
        return None
    if isinstance(x, dict):
        return {str(k): json_value(v) for k, v in x.items()}
    return [json_value(v) for v in x] if isinstance(x, (list, tuple)) else x


def write_report(report: dict, path: str) -> str:
    """Indented, in UTF-8, with a line feed at the end; folders are made. The report is one bounded object on the driver."""
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(json.dumps(json_value(report), indent=2, ensure_ascii=False, allow_nan=False) + "\n", encoding="utf-8")
    return str(at)


def report_lines(report: dict, metrics: tuple[str, ...]) -> list[str]:
    out = []
    for r in report["results"]:
        if r.get("error"):
            out.append(f"{r['id']}: ERROR - {r['error']}")
            continue
        scores = [f"{m}={v:.3f}" for m in metrics if isinstance(v := r.get(m), (int, float)) and not isinstance(v, bool) and math.isfinite(v)]
        out.append(f"{r['id']}: " + (", ".join(scores) or "no valid metric scores"))
    return [*out, json.dumps(json_value(report["summary"]), indent=2, ensure_ascii=False)]
