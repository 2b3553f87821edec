"""Durations of job configurations."""

from __future__ import annotations

import re
from datetime import timedelta

_UNITS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400}
_ISO = re.compile(r"P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?")


def parse_duration(text: str | None) -> timedelta:
    """ISO-8601 (``PT5M``) or a number with ms, s, m, h or d; blank is zero."""
    text = (text or "").strip()
    if not text:
        return timedelta(0)
    if m := re.fullmatch(r"(\d+)\s*(ms|s|m|h|d)", text.lower()):
        return timedelta(seconds=int(m[1]) * _UNITS[m[2]])
    if (m := _ISO.fullmatch(text.upper())) and any(m.groups()):
        days, hours, minutes, seconds = (float(g or 0) for g in m.groups())
        return timedelta(days=days, hours=hours, minutes=minutes, seconds=seconds)
    raise ValueError(f"not a duration: {text!r}")
