"""Literal texts one of which every match of a pattern contains.

Looking for a few literals is much cheaper than running a pattern, so most texts never reach the
pattern. Computed once on the driver; a pattern without such literals simply has no shortcut.
"""

from __future__ import annotations

import re
from functools import lru_cache

MIN_LENGTH, MAX_NEEDLES = 3, 40


def _better(a: list[str] | None, b: list[str] | None) -> list[str] | None:
    if a is None or b is None:
        return b if a is None else a
    return max(a, b, key=lambda s: (min(map(len, s)), -len(s)))


def _of_sequence(items) -> list[str] | None:
    best, run = None, ""
    for op, arg in [*items, (None, None)]:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg)
            continue
        if run:
            best, run = _better(best, [run]), ""
        if name == "SUBPATTERN":
            best = _better(best, _of_sequence(arg[-1]))
        elif name == "BRANCH":
            parts = [_of_sequence(branch) for branch in arg[1]]
            if all(parts):
                best = _better(best, sorted({n for p in parts for n in p}))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            best = _better(best, _of_sequence(arg[2]))
    return best


@lru_cache(maxsize=None)
def needles(pattern: str) -> tuple[str, ...] | None:
    """The literals, in lower case, or None when there is no useful set."""
    try:
        found = _of_sequence(re._parser.parse(pattern))
    except (re.error, AttributeError):
        return None
    if not found or min(map(len, found)) < MIN_LENGTH:
        return None
    lowered = sorted({n.lower() for n in found})
    # a literal inside a longer one already covers it
    kept = tuple(n for n in lowered if not any(m != n and m in n for m in lowered))
    return kept if len(kept) <= MAX_NEEDLES else None
