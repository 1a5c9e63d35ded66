"""Text to terms, with built-in expressions only."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges of characters that are one-character terms (CJ), and those shown as CJK.
CJ_RANGES = ((0x3040, 0x312F), (0x31F0, 0x31FF), (0x3300, 0x337F), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF65, 0xFF9F))
CJK_RANGES = ((0x1100, 0x11FF), (0x2E80, 0x2EFF), (0x3000, 0x9FFF), (0xA960, 0xA97F), (0xAC00, 0xD7FF), (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0xFF00, 0xFFEF))
MAX_WORD_LENGTH = 256


def _java_class(ranges) -> str:
    return "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in ranges)


CJ_CLASS, CJK_CLASS = _java_class(CJ_RANGES), _java_class(CJK_RANGES)


def python_class(ranges) -> str:
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges)


_CJ, _CJK = re.compile(f"[{python_class(CJ_RANGES)}]"), re.compile(f"[{python_class(CJK_RANGES)}]")


def is_cj(char: str) -> bool:
    return _CJ.match(char) is not None


def is_cjk(text: str) -> bool:
    return not text.isascii() and _CJK.search(text) is not None


def has_cjk(text: Column) -> Column:
    return text.rlike(f"[{CJK_CLASS}]")


def fold(word: Column) -> Column:
    """Lower case character by character: a final sigma is a sigma like any other."""
    each = F.array_join(F.transform(F.split(word, ""), lambda c: F.lower(c)), "")
    return F.when(F.contains(word, F.lit("Σ")), each).otherwise(F.lower(word))


@dataclass(frozen=True)
class Lexer:
    """Words are runs of letters, digits, _ and extra characters; a CJ character is a word by itself; longer words are cut.

    custom: a function of a text column that gives an array of terms; it excludes the other options.
    """

    extra: str = ""
    preserve_case: bool = False
    max_length: int = MAX_WORD_LENGTH
    custom: Callable[[Column], Column] | None = None

    def __post_init__(self):
        if self.custom and (self.extra or self.preserve_case or self.max_length != MAX_WORD_LENGTH):
            raise ValueError("a custom lexer excludes the lexer's options")
        if self.max_length < 1:
            raise ValueError("words have one character at least")

    @property
    def pattern(self) -> str:
        # ASCII comes first and plainly: an intersection of classes costs several times as much for each character.
        extra = [f"\\x{{{ord(c):X}}}" for c in self.extra if ord(c) >= 128]
        plain = "0-9A-Z_a-z" + "".join(f"\\x{{{ord(c):X}}}" for c in self.extra if ord(c) < 128)
        word = r"\p{L}\p{Nd}" + "".join(extra)
        return f"[{plain}[{word}&&[\\x{{80}}-\\x{{FFFF}}]&&[^{CJ_CLASS}]]]{{1,{self.max_length}}}|[{word}&&[{CJ_CLASS}]]"

    def terms(self, text: Column) -> Column:
        """array<string>; the index in it is the position. A null text has none."""
        if self.custom:
            return self.custom(text)
        found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))
        if self.preserve_case:
            return found
        return F.when(F.contains(text, F.lit("Σ")), F.transform(found, fold)).otherwise(F.transform(found, F.lower))

    def tokens(self, text: str) -> list[str]:
        """The same for a string on the driver: query strings."""
        out, word = [], ""
        for c in text:
            keep = c == "_" or c in self.extra or ord(c) <= 0xFFFF and (c.isalpha() and _letter(c) or c.isdecimal())
            if keep and not is_cj(c):
                word += c
                if len(word) < self.max_length:
                    continue
            if word:
                out.append(word)
                word = ""
            if keep and is_cj(c):
                out.append(c)
        out += [word] if word else []
        return out if self.preserve_case else ["".join(c.lower() for c in w) for w in out]

    def offsets(self, text: str) -> list[tuple[str, int]]:
        """(term, start) pairs of a string, starts in code points."""
        out, at = [], 0
        raw = Lexer(self.extra, True, self.max_length).tokens(text)
        for word, term in zip(raw, self.tokens(text), strict=True):
            at = text.index(word, at)
            out.append((term, at))
            at += len(word)
        return out


def _letter(c: str) -> bool:
    import unicodedata

    return unicodedata.category(c)[0] == "L"


def strip_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^﻿", "")


def like_escape(text: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", text)
