"""Risk-free rates, periods of a year, and look-back durations."""

from __future__ import annotations

import re

#: A rate for use without a market feed, and the day it was right.
RISK_FREE = 0.0378
RISK_FREE_AS_OF = "2026-06-12"
PERIODS_PER_YEAR = 252

_FRIENDLY = {f"{n}mo": f"{n} M" for n in (1, 3, 6)} | {f"{n}y": f"{n} Y" for n in (1, 2, 5)} | {"max": "5 Y"}


def risk_free(spec: str | float | None = None) -> tuple[float, str]:
    """The annual rate that spec means and where it comes from: None and "auto" stand for the built-in one, numbers and their texts for themselves."""
    if spec is None or str(spec).strip().lower() == "auto":
        return RISK_FREE, f"built-in rate as of {RISK_FREE_AS_OF}"
    return float(spec), "given by the user"


def duration(spec: str) -> str:
    """A look-back in the vendor's form, a count and a unit of S, D, W, M or Y: "1y" is "1 Y", "3650d" is "3650 D", "max" is "5 Y"."""
    text = spec.strip()
    if text.lower() in _FRIENDLY:
        return _FRIENDLY[text.lower()]
    found = re.fullmatch(r"(\d+)\s*([SDWMY])", text, re.IGNORECASE)
    if not found:
        raise ValueError(f"{spec!r} is no duration: write a count and S, D, W, M or Y, or one of {', '.join(_FRIENDLY)}")
    return f"{found[1]} {found[2].upper()}"
