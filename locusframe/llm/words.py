"""Words of cues: reading texts into word codes and hashed features."""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np

from .lexicon import CLASSES, LEET, LOOKALIKES

BITS = 18  # of a feature number
_CLOCK = r"\d+:[\d:.,]+"
_SETTING = r"(?:[ \t]+(?:align|line|position|size|region|vertical|[XY][12]):[^\s<]*)*"
# a line of times: both times and the known cue settings; other words of the line are text
_TIME = rf"(?:{_CLOCK}[ \t]*-->(?:[ \t]*[OolI]?\d[\dOolI:.,]*)?{_SETTING}|\{{\d+\}}\{{\d+\}})"
_CUT = re.compile(_TIME)
_JOIN = re.compile(rf"(?:\.\.\.|…)[^\w\n\r]{{0,20}}[\n\r]\s*(?:\d+\s*[\n\r]\s*)?{_TIME}[^\w\n\r]{{0,20}}\s*[^\w\n\r]{{0,20}}(?:\.\.\.|…)")
_MARKUP = re.compile(r"<[^<>\n]{0,80}>|\{\\[^}\n]*\}")
_ENTITY = re.compile(r"&(#39|apos|#x27)?[#\w]{0,6};")
_INSIDE = "\x01​‌‍⁠­"  # removed markup and invisible characters: part of the word around them
_SPACED = re.compile(r"[ .\-_*]\w[ .\-_*]\w(?!\w)")
_SPACED_WORD = r"(?<!\w)\w(?:[ .\-_*]\w){2,}(?!\w)|"
_PLAIN_WORD = rf"\0|[^\W_](?:[\w*@$€'’´{_INSIDE}-]*[\w*@$€])?"
_CP1252 = "‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œŸŽž€"
_BROKEN = re.compile(f"[ÃÂÐÑÄÅâ][\x80-\xbf{_CP1252}]|[À-ÿ]{{4}}")
_BROKEN_WORD = rf"\0|[^\W_÷×](?:[\w*@$'´÷×\x80-\x9f\xa2-\xbe{_CP1252}{_INSIDE}-]|(?<=[ÃÂÐÑÄÅ])[\xa0\xa1\xbf])*|[÷×][\w÷×]+"
_WORDS = {(a, b): re.compile((_SPACED_WORD if a else "") + (_BROKEN_WORD if b else _PLAIN_WORD)) for a in (False, True) for b in (False, True)}
_LETTER = re.compile(r"[^\W\d_]")
_ODD = re.compile(f"[\x80-\xff{_CP1252}]")
_REPEATS = re.compile(r"(.)\1{2,}")
_GAPS = re.compile(r"[ .\-_]")
_NONE = np.zeros(0, np.int64)
_UNSEEN = dict.fromkeys(map(ord, _INSIDE))


def _decoded(s: str) -> str:
    """Undo up to two wrong decodings of UTF-8, and Cyrillic read as Latin."""
    for _ in range(2):
        for codec in ("cp1252", "latin-1"):
            try:
                t = s.encode(codec).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            s = t
            break
        else:
            break
    if len(s) > 1 and all("\xc0" <= c <= "\xff" or c in "\xa8\xb8" for c in s):
        s = s.encode("latin-1").decode("cp1251", "replace")
    return s


class Reader:
    """Turns texts into sequences of word codes; the spelling of each distinct word is settled once."""

    def __init__(self, known: set[str] = frozenset()):
        self.lexicon = {w: k for k, words in CLASSES.items() for w in words}
        self.known = set(known) | set(self.lexicon)
        self.masked: dict[int, list[str]] = {}
        for w in self.lexicon:
            self.masked.setdefault(len(w), []).append(w)
        self.words = _Words(self)

    def spelling(self, raw: str) -> str:
        """The word in common spelling: encodings, look-alikes, digits for letters, gaps, stretched and swapped letters undone."""
        s = raw.translate(_UNSEEN)
        s = _decoded(s) if _ODD.search(s) else s
        s = unicodedata.normalize("NFKC", s).lower().replace("’", "'").replace("´", "'")
        if not s.isascii() and any("a" <= c <= "z" for c in s):
            s = "".join(LOOKALIKES.get(c, c) for c in s)
        if s in self.known:
            return s
        tried = [s]
        if any(c in LEET for c in s):
            tried += ["".join(LEET.get(c, c) for c in s), "".join({"1": "l"}.get(c) or LEET.get(c, c) for c in s)]
        for t in tried[:]:
            if _GAPS.search(t):
                tried.append(_GAPS.sub("", t))
        for t in tried[:]:
            if _REPEATS.search(t):
                tried += [_REPEATS.sub(r"\1", t), _REPEATS.sub(r"\1\1", t)]
        for t in tried[:]:
            tried += [t.replace(a, b) for a, b in (("rn", "m"), ("vv", "w"), ("ii", "ll"), ("l", "i"), ("i", "l"), ("0", "o"), ("c", "e")) if a in t]
        for t in tried:
            if t in self.known:
                return t
        for t in (s, _GAPS.sub("", s)):
            if "*" in t:
                pattern = re.compile(re.escape(t).replace(r"\*", "."))
                for w in self.masked.get(len(t), ()):
                    if pattern.fullmatch(w):
                        return w
                return "*"
            if 3 <= len(t) <= 12:
                for i in range(len(t) - 1):
                    swapped = t[:i] + t[i + 1] + t[i] + t[i + 2 :]
                    if swapped in self.lexicon:
                        return swapped
        return tried[1] if len(tried) > 1 and any(c in LEET for c in s) else s

    @staticmethod
    def _plain(text: str, in_place: bool = False) -> tuple[str, re.Pattern]:
        """The text with lines of times as cue marks and without markup, and the pattern of its words; a cue that runs on in the next is not cut.

        in_place: keep every word where it stands.
        """

        def by(mark: str) -> object:
            return (lambda m: mark.ljust(m.end() - m.start())) if in_place else mark

        text = text.replace("\0", " ")
        if "..." in text or "…" in text:
            text = _JOIN.sub(by(" "), text)
        text = _CUT.sub(by("\0"), text)
        if "<" in text or "{" in text:
            text = _MARKUP.sub((lambda m: "\1" * (m.end() - m.start())) if in_place else "\1", text)
        if "&" in text:
            text = _ENTITY.sub(lambda m: ("'" if m.group(1) else " ").ljust(m.end() - m.start() if in_place else 1, "\1" if m.group(1) else " "), text)
        return text, _WORDS[_SPACED.search(text) is not None, _BROKEN.search(text) is not None]

    def raw(self, text: str) -> list[str]:
        """The words of a text as they stand, with cue marks."""
        plain, word = self._plain(text)
        return word.findall(plain)

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(code, class) of every word, first word of every cue (and the total), text number of every cue; cues without words are left out."""
        if len(self.words) > 1_000_000:
            self.words = _Words(self)
        look = self.words.__getitem__
        per_text = [np.fromiter(map(look, self.raw(t)), np.int64) if t else _NONE for t in texts]
        number = np.concatenate(per_text) if per_text else _NONE
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in per_text])
        cue = np.cumsum(number == 0)
        real = number > 1
        number, owner, cue = number[real], owner[real], cue[real]
        code, kind = np.array(self.words.code, np.int32)[number], np.array(self.words.kind, np.int8)[number]
        if not len(number):
            return code, kind, np.zeros(1, np.int64), owner
        begin = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (cue[1:] != cue[:-1])])
        return code, kind, np.r_[begin, len(number)], owner[begin]

    def places(self, text: str) -> np.ndarray:
        """(start, end) in ``text`` of the words that ``read`` gives for it."""
        plain, word = self._plain(text, in_place=True)
        return np.array([m.span() for m in word.finditer(plain) if self.words[m.group()] > 1], np.int64).reshape(-1, 2)


class _Words(dict):
    """Number of each raw word: 0 the cue mark, 1 not a word; code and class by number."""

    def __init__(self, reader: Reader):
        super().__init__({"\0": 0})
        self.reader, self.code, self.kind = reader, [0, 0], [0, 0]

    def __missing__(self, raw: str) -> int:
        if raw.isdecimal() or not _LETTER.search(raw):
            number = 1
        else:
            s = self.reader.spelling(raw)
            number = len(self.code)
            self.code.append(zlib.crc32(s.encode()) & 0x7FFFFFFF | 4)
            self.kind.append(4 if s == "*" else self.reader.lexicon.get(s, 0))
        self[raw] = number
        return number


#: Columns of ``features`` that are word n-grams.
GRAMS = (1, 2, 3)


def features(code: np.ndarray, kind: np.ndarray, begin: np.ndarray, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Hashed feature numbers of the words lo..hi, [words, features]: the word, its class, and both with their neighbours in the cue."""
    hi = len(code) if hi is None else hi
    a, b = max(0, lo - 2), min(len(code), hi + 1)
    n, code, kind = b - a, code[a:b], kind[a:b]
    if hi <= lo:
        return np.zeros((0, 10), np.int32)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    heads, tails = begin[:-1] - a, begin[1:] - 1 - a
    first[heads[(heads >= 0) & (heads < n)]] = True
    last[tails[(tails >= 0) & (tails < n)]] = True
    second = np.r_[False, first[:-1]] | first

    def shift(x: np.ndarray, by: int) -> np.ndarray:
        out = np.roll(x, by)
        if by == 1:
            out[first] = 1
        elif by == 2:
            out[second] = 1
        else:
            out[last] = 2
        return out

    before, before2, after, kind_before, kind_after = shift(code, 1), shift(code, 2), shift(code, -1), shift(kind, 1), shift(kind, -1)
    columns = (
        (code,), (before, code), (code, after), (before2, before, code), (before, after),
        (kind,), (kind, before), (kind, after), (kind, before2, before), (kind, kind_before, kind_after),
    )
    inner = slice(lo - a, hi - a)
    out = np.empty((hi - lo, len(columns)), np.int32)
    for i, column in enumerate(columns):
        h = np.full(hi - lo, 0x9E37 + 7919 * i, np.uint64)
        for c in column:
            h ^= c[inner].astype(np.uint64)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
        out[:, i] = (h & np.uint64((1 << BITS) - 1)).astype(np.int32)
    return out
