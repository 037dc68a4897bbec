"""Patterns in Python's notation as Spark's engine, which is Java's, takes them."""

from __future__ import annotations

import re
import unicodedata

from .names import DataQualityError

_GROUP = re.compile(r"\(\?P<(\w+)>|\(\?P=(\w+)\)|\(\?#[^)]*\)|\(\?([aiLmsux]*)(?:-([imsx]+))?([:)])")
_COUNT = re.compile(r"\{(\d*)(?:(,)(\d*))?\}")
_NAMED = re.compile(r"N\{([^}]+)\}|U([0-9A-Fa-f]{8})|(0[0-7]{0,2}|[1-3][0-7]{2})|([vZ])")
_UNICODE = re.compile(r"\\[dDwWsSbB]|\(\?[a-zL]*i")


def _escape(pattern: str, at: int, inside: bool) -> tuple[str, int]:
    """What stands for the escape at ``at``, and where it ends."""
    if m := _NAMED.match(pattern, at + 1):
        name, code, octal, letter = m.groups()
        if letter == "Z" and inside:
            return r"\Z", m.end()
        if letter:
            return {"v": r"\x0B", "Z": r"\z"}[letter], m.end()
        point = ord(unicodedata.lookup(name)) if name else int(code, 16) if code else int(octal, 8)
        return f"\\x{{{point:x}}}", m.end()
    return pattern[at : at + 2], at + 2


def _class(pattern: str, at: int) -> tuple[str, int]:
    """The character class that begins at ``at``; Java's unions and cuts are literal here."""
    out, at = "[", at + 1
    if pattern[at] == "^":
        out, at = out + "^", at + 1
    first = True
    while first or pattern[at] != "]":
        c = pattern[at]
        if c == "\\":
            part, at = _escape(pattern, at, True)
        else:
            part, at = ("\\" + c if c in "[]&" else c), at + 1
        out, first = out + part, False
    return out + "]", at + 1


def _group(m: re.Match, names: dict[str, str]) -> str:
    """What stands for the beginning of a group, or for what is no group of Java's."""
    name, again, on, off, end = m.groups()
    if name:
        return f"(?<{names.setdefault(name, f'g{len(names)}')}>"
    if again:
        return f"\\k<{names[again]}>"
    if end is None:
        return ""
    if "L" in on:
        raise DataQualityError("Patterns that follow a locale can't be evaluated.")
    plus = "".join(c for c in on if c in "imsx") + ("U" if "u" in on else "")
    minus = (off or "") + ("U" if "a" in on else "")
    return f"(?{plus}{'-' if minus else ''}{minus}{end}" if plus or minus or end == ":" else ""


def java_pattern(pattern: str) -> str:
    """``pattern`` with the meaning that Python gives it: classes are those of Unicode, only a
    line feed ends a line. White space lacks the four separators U+001C to U+001F. Conditions
    on groups have no counterpart and are an error."""
    try:
        re.compile(pattern)
    except re.error as problem:
        raise DataQualityError(f"Invalid regular expression: {problem}") from None
    out, at, names = [], 0, {}
    while at < len(pattern):
        c = pattern[at]
        if pattern.startswith("(?(", at):
            raise DataQualityError("Patterns with conditions on groups can't be evaluated.")
        if c == "\\":
            part, at = _escape(pattern, at, False)
        elif c == "[":
            part, at = _class(pattern, at)
        elif c == "{":
            m = _COUNT.match(pattern, at)
            counted = m and (m[1] or m[2])
            part, at = (f"{{{m[1] or 0}{m[2] or ''}{m[3] or ''}}}", m.end()) if counted else ("\\{", at + 1)
        elif m := _GROUP.match(pattern, at):
            part, at = _group(m, names), m.end()
        else:
            part, at = c, at + 1
        out.append(part)
    return ("(?dU)" if _UNICODE.search(pattern) else "(?d)") + "".join(out)
