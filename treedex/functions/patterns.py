"""Patterns written in Python's dialect of regular expressions as Java's, which Spark runs.

A pattern is valid if Python takes it between word boundaries; what Python takes and Java would read otherwise is rewritten piece by piece: names of groups,
references to them, conditions on a group, ends of the text, white space, digits and word characters of Unicode, brackets and braces that stand for
themselves, codes of characters, comments.
"""

from __future__ import annotations

import re
import warnings

#: Unicode's white space and the separators \x1c to \x1f; letters, digits and _; decimal digits.
SPACE, WORD, DIGIT = r"\s\x1c-\x1f", r"\p{L}\p{N}_", r"\p{Nd}"
_CLASSES = {"s": SPACE, "w": WORD, "d": DIGIT}
_CONTROLS = {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11}
_QUANTITY = re.compile(r"\{(\d*)(?:(,)(\d*))?\}")
_CONDITION = re.compile(r"\(\?\((\w+)\)")
_FLAGS = re.compile(r"\(\?([aLiumsx]*)(?:-([imsx]+))?:")
_JAVA_FLAGS = {"i": "i", "m": "m", "s": "s", "x": "x"}


def _char(code: int) -> str:
    return rf"\x{{{code:x}}}"


def _named(group: int) -> str:
    return f"g{group}"


class _Reader:
    """One pass over a pattern that Python takes."""

    def __init__(self, pattern: str):
        compiled = re.compile(pattern)
        self.names, self.p, self.at, self.open, self.groups = compiled.groupindex, pattern, 0, [], 0
        self.asked = set()  # groups that a condition asks about
        for m in _CONDITION.finditer(pattern):
            if (n := self._number(m[1])) is not None:
                self.asked.add(n)

    def _number(self, name: str) -> int | None:
        return int(name) if name.isdigit() else self.names.get(name)

    def all(self) -> str:
        out = []
        while self.at < len(self.p):
            out.append(self._piece())
        return "".join(out)

    def _take(self, n: int = 1) -> str:
        s = self.p[self.at : self.at + n]
        self.at += n
        return s

    def _piece(self) -> str:
        c = self.p[self.at]
        if c == "\\":
            return self._escape()
        if c == "[":
            return self._class()
        if c == "(":
            return self._group()
        if c == "{":
            m = _QUANTITY.match(self.p, self.at)
            if m and (m[1] or m[2]):
                self._take(len(m[0]))
                return f"{{{m[1] or 0}{m[2] or ''}{m[3] or ''}}}"
            self._take()
            return r"\{"
        if c == ")":
            self._take()
            end = self.open.pop()
            return rf")|(?!\k<c{end[1:]}>))" if end.startswith("?") else end
        if c == "|" and self.open and self.open[-1].startswith("?"):  # between a condition's two branches
            group = int(self.open.pop()[1:])
            self.open.append("))")
            self._take()
            return rf")|(?!\k<c{group}>)(?:"
        if c in "]}":
            self._take()
            return "\\" + c
        return self._take()

    def _group(self) -> str:
        rest = self.p[self.at :]
        if m := _CONDITION.match(rest):
            self._take(len(m[0]))
            n = self._number(m[1])
            self.open.append(f"?{n}")
            return rf"(?:\k<c{n}>(?:"
        if rest.startswith("(?#"):
            self._take(rest.index(")") + 1)
            return ""
        if m := re.match(r"\(\?P=(\w+)\)", rest):
            self._take(len(m[0]))
            return rf"\k<{_named(self.names[m[1]])}>"
        named = re.match(r"\(\?P<\w+>", rest)
        if named or not rest.startswith("(?"):
            self._take(len(named[0]) if named else 1)
            self.groups += 1
            asked = self.groups in self.asked
            self.open.append(rf")(?<c{self.groups}>))" if asked else ")")
            return ("(?:" if asked else "") + f"(?<{_named(self.groups)}>"
        if m := _FLAGS.match(rest):
            self._take(len(m[0]))
            on, off = "".join(_JAVA_FLAGS.get(f, "") for f in m[1]), m[2] or ""
            self.open.append(")")
            return f"(?{on}{'-' + off if off else ''}:"
        if m := re.match(r"\(\?[aiLmsux]+\)", rest):  # flags for all of the pattern, at its start
            self._take(len(m[0]))
            on = "".join(_JAVA_FLAGS.get(f, "") for f in m[0])
            return f"(?{on})" if on else ""
        m = re.match(r"\(\?(?:<?[=!]|>)", rest)
        self._take(len(m[0]))
        self.open.append(")")
        return m[0]

    def _code(self) -> int | None:
        """A character by its code, after the backslash; None if it is something else."""
        rest = self.p[self.at :]
        for lead, digits in (("x", 2), ("u", 4), ("U", 8)):
            if rest.startswith(lead):
                self._take(1 + digits)
                return int(rest[1 : 1 + digits], 16)
        if m := re.match(r"N\{[^}]*\}", rest):
            self._take(len(m[0]))
            import unicodedata

            return ord(unicodedata.lookup(m[0][2:-1]))
        if m := re.match(r"0[0-7]{0,2}|[0-3][0-7]{2}", rest):
            self._take(len(m[0]))
            return int(m[0], 8)
        return None

    def _escape(self) -> str:
        self._take()
        if (code := self._code()) is not None:
            return _char(code)
        if m := re.match(r"[1-9]\d?", self.p[self.at :]):
            self._take(len(m[0]))
            return rf"\k<{_named(int(m[0]))}>"
        c = self._take()
        if c in "swd":
            return f"[{_CLASSES[c]}]"
        if c in "SWD":
            return f"[^{_CLASSES[c.lower()]}]"
        if c == "Z":
            return r"\z"
        if c in "AB" or c == "b":
            return "\\" + c
        if c in _CONTROLS:
            return _char(_CONTROLS[c])
        return "\\" + c if not c.isalnum() and c.isascii() else c

    def _class(self) -> str:
        self._take()
        out = "["
        if self.p[self.at] == "^":
            out += self._take()
        first = True
        while first or self.p[self.at] != "]":
            first = False
            c = self._take()
            if c != "\\":
                out += "\\" + c if c in "[]&^# " else c
                continue
            if (code := self._code()) is not None:
                out += _char(code)
                continue
            c = self._take()
            out += _CLASSES[c] if c in "swd" else f"[^{_CLASSES[c.lower()]}]" if c in "SWD" else _char(_CONTROLS[c]) if c in _CONTROLS else "\\" + c if not c.isalnum() and c.isascii() else c
        self._take()
        return out + "]"


def valid(pattern: str, whole: str = r"\b(?:{})\b") -> bool:
    """Whether Python takes a pattern, between word boundaries unless another frame is given."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            re.compile(whole.replace("{}", pattern))
    except (re.error, RecursionError, OverflowError):
        return False
    return True


def java(pattern: str) -> str:
    """The same pattern for Java, to be run with the flags d (a line ends at \\n alone) and U; a pattern of letters, digits and blanks is as it was. ValueError if Python doesn't take it.

    Differences that stay: a combining mark after a letter belongs to the word for Java's \\b; a group inside a negated one of the kind [^\\S..] follows Java.
    """
    if not re.search(r"[\\()\[\]{}]", pattern):
        return pattern
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return _Reader(pattern).all()
    except (re.error, IndexError, KeyError, AttributeError) as e:
        raise ValueError(f"not a pattern: {pattern}") from e
