"""Text specifications of parameter ranges and of wavelengths; reports."""

from __future__ import annotations

import re

NUMBER = r"[-+]?\d+(?:\.\d+)?(?:e[-+]?\d+)?"
STEPS = re.compile(rf"({NUMBER})\s*-\s*({NUMBER})\s+step\s+(\S+)", re.I)


def parse_range(text: str, name: str, kind: type = float, allow_none: bool = False) -> list:
    """"1, 5-9 step 2, None": numbers sorted once each after None; strings keep their order; empty gives []."""
    out: list = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        if part.lower() == "none" and allow_none:
            out.append(None)
        elif kind is str:
            out.append(part)
        elif m := STEPS.fullmatch(part):
            try:
                a, b, s = kind(m[1]), kind(m[2]), kind(m[3])
            except ValueError:
                raise ValueError(f"{name}: {part!r} isn't a range of {kind.__name__}") from None
            if s <= 0:
                raise ValueError(f"{name}: a step must be above 0")
            a, b = min(a, b), max(a, b)
            out += [kind(round(a + k * s, 12)) for k in range(int((b - a) / s + 1e-9) + 1)]
        else:
            try:
                out.append(kind(part))
            except ValueError:
                raise ValueError(f"{name}: {part!r} isn't a {kind.__name__} or a range with a step") from None
    if kind is str:
        return list(dict.fromkeys(out))
    return [None] * (None in out) + sorted({x for x in out if x is not None})


def parse_wavelengths(text: str, axis: list[float]) -> list[float]:
    """"1400-1500, 1920": inclusive ranges and single values, of those the axis has."""
    out = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)", part)
        lo, hi = (float(m[1]), float(m[2])) if m else (float(part) - 0.01, float(part) + 0.01)
        out |= {w for w in axis if lo <= w <= hi}
    return sorted(out)


def is_regression(values: list, least: int = 10) -> bool:
    """Numbers with `least` or more distinct values, or any fraction."""
    if any(isinstance(v, str) for v in values):
        return False
    return len(set(values)) >= least or any(float(v) != int(v) for v in values)


def markdown_report(target: str, ranked: list[dict], top: int = 5) -> str:
    head = f"# {target}\n\n"
    parts = [f"## {k + 1}. {r['model']} on {r['preprocess']}\n\n" + "".join(f"- {a}: {b}\n" for a, b in r.items()) for k, r in enumerate(ranked[:top])]
    return head + "\n".join(parts)
