"""Gate results as text: plain tables of the stored rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

TITLES = {"G0": "coverage and depth", "G1": "settlement parity", "G2": "calibration", "G3": "lead and lag", "G4": "verdict"}


def cell(x: object) -> str:
    if x is None:
        return "-"
    if isinstance(x, bool):
        return "yes" if x else "no"
    if isinstance(x, float):
        return format(x, ".4f")
    return ", ".join(map(cell, x)) if isinstance(x, list | tuple) else str(x)


def table(rows: Iterable[Mapping]) -> list[str]:
    """Lines of a table with a column for each key, as wide as its longest cell."""
    rows = list(rows)
    if not rows:
        return ["(no rows)"]
    columns = [[name, *(cell(r.get(name)) for r in rows)] for name in rows[0]]
    widths = [max(map(len, c)) for c in columns]
    return ["  ".join(x.ljust(w) for x, w in zip(line, widths, strict=True)).rstrip() for line in zip(*columns, strict=True)]


def render(payload: Mapping) -> str:
    """A stored gate result for a reader: its name, the rules it was held to, every table of it, caveats and inputs."""
    lines = [f"{payload['gate']}: {TITLES[payload['gate']]}"]
    if payload["gate"] == "G4":
        first = (payload["rows"] or [{"verdict": "no regime"}])[0]
        lines.append(f"VERDICT: {first['verdict']}")
    for name in ("frozen_rules", "sweep", "inputs"):
        lines += [f"{name}: " + "; ".join(f"{k} {cell(v)}" for k, v in payload[name].items())] if payload.get(name) else []
    for name, value in payload.items():
        if name == "rows" or isinstance(value, list) and value and isinstance(value[0], Mapping):
            lines += ["", f"[{name}]", *table(value)]
    return "\n".join([*lines, *(f"note: {x}" for x in payload.get("caveats", ()))])
