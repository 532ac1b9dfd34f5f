"""Scalar helper of the stateful stream operator."""

from __future__ import annotations

import math
from collections.abc import Sequence


def nowcast_value(window: Sequence[float | None], size: int = 12) -> float | None:
    """T20 for one window, oldest first; the batch operator states the same rule in columns."""
    seen = [v for v in window if v is not None]
    if len(window) < size or sum(v is None for v in window[-3:]) >= 2:
        return None
    high, low = max(seen), min(seen)
    if high == 0:
        return 0.0
    w = max(0.5, 1 - (high - low) / high)
    num = den = 0.0
    for v in window:
        num = num * w + (v if v is not None else 0.0)
        den = den * w + (v is not None)
    return max(0.0, math.trunc(num / den * 10) / 10)
