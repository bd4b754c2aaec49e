"""Text rendering with Python format-spec semantics, as Column expressions.

``format_number`` rounds half-even on the exact binary value, like Python's
``format``; ``format_string('%f')`` does not, so it is avoided.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NA = "N/A"


def money(x: Column, decimals: int = 2) -> Column:
    """``f"{x:,.{d}f}"``."""
    return F.format_number(x.cast("double"), decimals)


def fixed(x: Column, decimals: int = 2) -> Column:
    """``f"{x:.{d}f}"`` (no grouping)."""
    return F.regexp_replace(F.format_number(x.cast("double"), decimals), ",", "")


def percent(x: Column, decimals: int = 0) -> Column:
    """``f"{x:.{d}%}"``: value times 100, fixed decimals, then '%'."""
    return F.concat(fixed(x.cast("double") * F.lit(100.0), decimals), F.lit("%"))


def render_value(x: Column, spec: str) -> Column:
    """Render one replacement field; null renders as 'N/A'."""
    if spec == "":
        out = x.cast("string")
    elif spec.endswith("%"):
        out = percent(x, int(spec[1:-1] or 6))
    elif spec.endswith("f"):
        body = spec[:-1]
        grouped = body.startswith(",")
        decimals = int(body.lstrip(",").lstrip(".") or 6)
        out = money(x, decimals) if grouped else fixed(x, decimals)
    else:
        raise ValueError(f"unsupported format spec {spec!r}")
    return F.coalesce(out, F.lit(NA))


_FIELD = re.compile(r"\{([A-Za-z_][A-Za-z0-9_]*)(?::([^}]*))?\}")


def render_template(template: str, cols: dict[str, Column] | None = None) -> Column:
    """Turn ``"… {name:spec} …"`` into a ``concat`` of literals and fields.

    Field names resolve to the frame's columns unless ``cols`` overrides them.
    """
    cols = cols or {}
    parts: list[Column] = []
    pos = 0
    for m in _FIELD.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        name, spec = m.group(1), m.group(2) or ""
        parts.append(render_value(cols.get(name, F.col(name)), spec))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if parts else F.lit("")


def template_fields(template: str) -> list[str]:
    return [m.group(1) for m in _FIELD.finditer(template)]
