"""Text normal forms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every code point with the Unicode property White_Space, and the four ASCII separators.
WIDE_WHITE = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
WHITE = r"[\x09-\x0d\x1c-\x20" + "".join(f"\\x{{{c:x}}}" for c in WIDE_WHITE) + "]"


def trim_white(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"\A{WHITE}+|{WHITE}+\z", "")


def uniform_keyword(c: Column) -> Column:
    """Lower case, no white space around it; null stays null, only white space becomes ''."""
    return F.lower(trim_white(c))
