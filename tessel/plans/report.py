"""Timings as JSON, CSV and Markdown files."""

from __future__ import annotations

import csv
import dataclasses
import json
from collections.abc import Mapping
from pathlib import Path

from tessel.plans.runner import Timing


def write(found: Mapping[str, Timing], folder: str) -> None:
    """``profile.json``, ``profile.csv`` and ``profile.md`` with a row per query, in a folder of the driver's."""
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    rows = {name: dataclasses.asdict(x) for name, x in found.items()}
    (at / "profile.json").write_text(json.dumps(rows, indent=1))
    columns = ["query", *(f.name for f in dataclasses.fields(Timing))]
    with (at / "profile.csv").open("w", newline="") as f:
        out = csv.DictWriter(f, columns)
        out.writeheader()
        out.writerows({"query": name} | row for name, row in rows.items())
    said = lambda x: f"{x:.4f}" if isinstance(x, float) else str(x).replace("|", "\\|")
    lines = [columns, ["---"] * len(columns), *([name, *row.values()] for name, row in rows.items())]
    (at / "profile.md").write_text("".join(f"| {' | '.join(map(said, line))} |\n" for line in lines))
