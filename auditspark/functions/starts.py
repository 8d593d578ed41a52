"""The same pattern with cheap tests in front of its word boundaries and alternatives.

A pattern is tried at every place of a text. A word boundary is the dearest of its tests, and a list of alternatives has
one for each, so what must follow a boundary is looked at first, and places where no alternative can begin are passed over
by one test of a character. Both are conditions that every match meets anyway, so matches, groups and places stay the same.
"""

from __future__ import annotations

import re
from functools import lru_cache

META = frozenset(".^$*+?{}[]()|\\")
WORD = re.compile(r"[A-Za-z0-9_]")
TOKEN = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\((?:\?(?:<?[=!]|:))?|.", re.S)
# a class that stays the same among others: no negation, no single dash
PLAIN_CLASS = re.compile(r"\[(?:\w-\w|\\\W|[^\\\-\[\]^&])+\]")
GROUPS, LOOKS = ("(", "(?:"), ("(?=", "(?!", "(?<=", "(?<!")
MIN_ALTERNATIVES = 3


def _literal(token: str) -> str | None:
    if len(token) == 1:
        return None if token in META else token
    return token[1] if token[0] == "\\" and not token[1].isalnum() and token[1].isascii() else None


def _end(tokens: list[str], at: int) -> int:
    """Index of the bracket that closes the group opened at *at*."""
    depth = 0
    for i in range(at, len(tokens)):
        depth += tokens[i].startswith("(") - (tokens[i] == ")")
        if depth == 0:
            return i
    raise ValueError("unbalanced pattern")


def _alternatives(tokens: list[str]) -> list[list[str]]:
    out, depth = [[]], 0
    for t in tokens:
        depth += t.startswith("(") - (t == ")")
        if t == "|" and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    return out


def _optional(tokens: list[str], at: int) -> bool:
    return at < len(tokens) and tokens[at] in ("?", "*", "{")


def _firsts(tokens: list[str]) -> set[tuple[str, str]] | None:
    """(kind, text) of what a match of the sequence can begin with: a character after a boundary, a class, or the start of a line."""
    boundary, i = False, 0
    while i < len(tokens):
        t = tokens[i]
        if t == r"\b":
            boundary, i = True, i + 1
        elif t in LOOKS:
            i = _end(tokens, i) + 1
        elif t == "^":
            return {("line", "^")}
        elif t in GROUPS:
            end = _end(tokens, i)
            if tokens[i + 1] == "?" or _optional(tokens, end + 1):  # flags of a group's own, or nothing that must be there
                return None
            found = [_firsts(a) for a in _alternatives(tokens[i + 1:end])]
            if any(f is None for f in found):
                return None
            return {("word" if boundary and kind == "any" and WORD.fullmatch(text) else kind, text) for f in found for kind, text in f}
        elif _optional(tokens, i + 1):
            return None
        elif t[0] == "[" and PLAIN_CLASS.fullmatch(t):
            return {("any", t[1:-1])}
        else:
            c = _literal(t)
            if c is None:
                return None
            return {("word" if boundary and WORD.fullmatch(c) else "any", c if c.isalnum() else "\\" + c if c.isascii() and c != "_" else c)}
    return None


def _class(texts) -> str:
    return "(?=[" + "".join(sorted(texts)) + "])"


def _ahead(tokens: list[str], at: int) -> str:
    """A test of what follows the boundary at *at*; empty when nothing certain does."""
    run, i = [], at + 1
    while i < len(tokens) and _literal(tokens[i]) is not None and not _optional(tokens, i + 1):
        run.append(tokens[i])
        i += 1
    if run:
        return "(?=" + "".join(run) + ")"
    if i < len(tokens) and tokens[i] in GROUPS:
        found = _firsts(tokens[i:_end(tokens, i) + 2])
        if found and all(kind in ("any", "word") for kind, _ in found):
            return _class(text for _, text in found)
    return ""


@lru_cache(maxsize=None)
def quick(pattern: str) -> str:
    """The pattern with those tests."""
    flags = re.match(r"(?:\(\?[a-z]+\))?", pattern).group()
    tokens = TOKEN.findall(pattern[len(flags):])
    body = "".join(_ahead(tokens, i) + t if t == r"\b" else t for i, t in enumerate(tokens))
    parts = _alternatives(tokens)
    found = [_firsts(p) for p in parts]
    if len(parts) < MIN_ALTERNATIVES or any(f is None for f in found):
        return flags + body
    kinds = {kind: {text for f in found for k, text in f if k == kind} for kind in ("word", "any", "line")}
    tests = [_class(kinds["word"]) + r"\b"] if kinds["word"] else []
    tests += [_class(kinds["any"])] if kinds["any"] else []
    return f"{flags}(?:{'|'.join(tests + sorted(kinds['line']))})(?:{body})"
