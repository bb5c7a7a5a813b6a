"""Unicode folding: entities, wrongly decoded text, compatibility forms, and Traditional Han to Simplified.

The first three have no built-in expression and run on Arrow batches; give them distinct surfaces rather than every
occurrence. Folding of single Han characters is an expression. Nulls stay null and empty texts empty everywhere.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Code points that Han characters are looked up in: the main block, extension A and the compatibility block.
HAN_RANGES = ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00))


def _legacy_bytes() -> dict[str, int]:
    """Each character as the byte that a single-byte Western reading takes it for; unused bytes are control characters."""
    found = {}
    for b in range(0x80, 0x100):
        found[chr(b)] = b
        try:
            found[bytes([b]).decode("cp1252")] = b
        except UnicodeDecodeError:
            pass
    return found


LEGACY = _legacy_bytes()


#: Marks that close a quotation: after a capital with an accent they are taken for what they are.
QUOTES = "«»‘’“”‹›"


def _class(low: int, high: int, without: str = "") -> str:
    return "[" + "".join(re.escape(c) for c, b in sorted(LEGACY.items()) if low <= b <= high and c not in without) + "]"


_TAIL = _class(0x80, 0xBF)
#: Characters of two to four bytes, each byte read as one character.
MISREAD = re.compile(f"(?:[ÂÃ]{_TAIL}|{_class(0xC4, 0xDF)}{_class(0x80, 0xBF, QUOTES)}|{_class(0xE0, 0xEF)}{_TAIL}{{2}}|{_class(0xF0, 0xF4)}{_TAIL}{{3}})+")


def _reread(found: re.Match) -> str:
    try:
        return bytes(LEGACY[c] for c in found[0]).decode("utf-8")
    except UnicodeDecodeError:
        return found[0]


def repaired(text: str) -> str:
    """UTF-8 that was read as a single-byte Western encoding, read again; twice where it was misread twice."""
    for _ in range(2):
        again = MISREAD.sub(_reread, text)
        if again == text:
            break
        text = again
    return text


def decoded(text: Column) -> Column:
    """Wrongly decoded characters repaired, canonically composed, and all named and numeric entities decoded."""

    @F.pandas_udf("string")
    def decode(texts: pd.Series) -> pd.Series:
        one = lambda t: t if t is None or t.isascii() and "&" not in t else html.unescape(unicodedata.normalize("NFC", repaired(t)))
        return texts.map(one, na_action="ignore")

    return decode(text)


def nfkc(text: Column) -> Column:
    """Normalisation form KC: ligatures, full-width and other compatibility forms."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")

    return fold(text)


def han_pairs(spark: SparkSession) -> tuple[str, str]:
    """Traditional characters and their Simplified ones, place by place, by the public rules that Spark's own libraries hold."""
    chars = [chr(c) for low, high in HAN_RANGES for c in range(low, high)]
    rules = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified")
    folded = rules.transliterate("\n".join(chars)).split("\n")
    pairs = [(a, b) for a, b in zip(chars, folded, strict=True) if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def simplified(text: Column, pairs: tuple[str, str], phrases: dict[str, str] | None = None) -> Column:
    """Traditional Han as Simplified: the longest phrase at each place first, then single characters.

    phrases is a table for words whose characters have several Simplified forms; what it gives is not folded again.
    """
    if not phrases:
        return F.translate(text, *pairs)
    longest = re.compile("|".join(re.escape(p) for p in sorted(phrases, key=len, reverse=True)) + "|.", re.S)
    single = dict(zip(*pairs, strict=True))

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        one = lambda m: phrases[m[0]] if m[0] in phrases else single.get(m[0], m[0])
        return texts.map(lambda t: longest.sub(one, t), na_action="ignore")

    return fold(text)
