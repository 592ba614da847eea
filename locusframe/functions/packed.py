"""Tokenizer for fields that pack several values into one string.

A finite-state scanner with three item states: *quoted* (an enclosing quote is open; a doubled quote
or an escaped one is a literal), *known* (the item is a value of the dictionary, whose own punctuation
does not separate) and *plain* (up to the next separator at bracket depth zero).
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable
from functools import cache

PAD = " \t\r\n_"
_KEPT = set("._'\"`´‘’ʼ“”„«»")
_KEPT_CATEGORIES = {"Pd", "Ps", "Pe", "Pc", "Pi", "Pf", "Mn", "Mc"}


def is_separator(ch: str) -> bool:
    """Punctuation, symbols and control characters separate; hyphens, brackets, quotes, underscores and full stops never do."""
    category = unicodedata.category(ch)
    return (category[0] in "PS" or category in ("Cc", "Zl", "Zp")) and category not in _KEPT_CATEGORIES and ch not in _KEPT


@cache
def _separator() -> re.Pattern:
    """Pattern of one separator, made once per Python worker."""
    spans, start, last = [], None, None
    for code in range(sys.maxunicode + 1):
        if is_separator(chr(code)):
            if start is None:
                start = code
            last = code
        elif start is not None:
            spans.append((start, last))
            start = None
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]")


class PackedTokenizer:
    """Splits one packed field into its values.

    ``terms``: known values, compared without case and with underscore as blank; only those with a
    separator inside matter. ``escape``: a character that makes a following quote literal inside quotes.
    ``brackets``: when true, separators inside balanced brackets do not separate.
    """

    OPEN, CLOSE = "([{", ")]}"

    def __init__(self, terms: Iterable[str] = (), escape: str | None = "\\", brackets: bool = False):
        self.find = _separator().search
        self.escape, self.brackets = escape, brackets
        self.known: dict[str, list[str]] = {}
        for t in {self._fold(t).strip(PAD) for t in terms if t}:
            if m := self.find(t):
                self.known.setdefault(t[: m.start()], []).append(t)
        for same in self.known.values():
            same.sort(key=len, reverse=True)

    @staticmethod
    def _fold(s: str) -> str:
        low = s.lower()
        if len(low) != len(s):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in s)
        return low.replace("_", " ")

    def firsts(self, s: str) -> set[str]:
        """What stands, in comparison form, from each place where an item may begin to the next separator: a known value in ``s`` begins with one of them."""
        folded, i, out = self._fold(s), 0, set()
        while i < len(s):
            m = self.find(s, i)
            end = m.start() if m else len(s)
            out.add(folded[i:end].lstrip(" "))
            i = end + 1
        return out

    def _boundary(self, s: str, i: int) -> int:
        """Where the separator (or the end) stands if only padding lies between it and ``i``; else -1."""
        n = len(s)
        while i < n and s[i] in " _":
            i += 1
        return i if i == n or self.find(s[i]) else -1

    def _quoted(self, s: str, i: int, open_ended: set[str]) -> tuple[str, int] | None:
        """The value of the quotes opened at ``i`` and where it ends; None when they enclose no value.

        open_ended: quotes for which an earlier search has found no end. Behind the run of quotes at ``i`` that search saw what this one would see, so it is not
        made again, and a text full of open quotes takes time in proportion to its length.
        """
        quote, n, out, j = s[i], len(s), [], i + 1
        if s.startswith(quote, j) and (end := self._boundary(s, j + 1)) >= 0:
            return "", end
        while j < n:
            c = s[j]
            if quote in open_ended and c != quote:
                return None
            if c == self.escape and j + 1 < n and s[j + 1] == quote:
                out.append(quote)
                j += 2
            elif c != quote:
                out.append(c)
                j += 1
            elif s.startswith(quote, j + 1):
                out.append(quote)
                j += 2
            elif (end := self._boundary(s, j + 1)) >= 0:
                return "".join(out), end
            else:
                out.append(c)
                j += 1
        open_ended.add(quote)
        return None

    def _plain_end(self, s: str, i: int) -> int:
        m = self.find(s, i)
        if not self.brackets or m is None:
            return m.start() if m else len(s)
        depth, first = 0, m.start()
        for j in range(i, len(s)):
            if s[j] in self.OPEN:
                depth += 1
            elif s[j] in self.CLOSE:
                depth = max(0, depth - 1)
            elif depth == 0 and self.find(s[j]):
                return j
        return len(s) if depth == 0 else first  # a bracket that is never closed protects nothing

    def __call__(self, s: str | None) -> list[str]:
        """Values in order, without enclosing quotes and padding; empty pieces are skipped. Null or empty text: no values."""
        if not s:
            return []
        folded, n, i, out, open_ended = self._fold(s), len(s), 0, [], set()
        while i < n:
            while i < n and s[i] in " _":
                i += 1
            if i == n:
                break
            if s[i] in "\"'" and (found := self._quoted(s, i, open_ended)):
                item, end = found
            else:
                end = self._plain_end(s, i)
                for t in self.known.get(folded[i:end], ()) if end < n else ():
                    if folded.startswith(t, i) and (past := self._boundary(s, i + len(t))) >= 0:
                        end = past
                        break
                item = s[i:end]
            if item := item.strip(PAD):
                out.append(item)
            i = end + 1
        return out
