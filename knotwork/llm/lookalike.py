"""One consistent form for texts that look the same.

Strings and code points that look alike are united into transitive classes by
union-find: by rule from the Unicode database (widths, ligatures, kinds of white
space), and from the whole table of confusable characters that the Unicode
library of the JVM carries. Everything is in decomposed form, so a composed
letter is alike to its parts, and to those of any alike letter. Of each class
the member that the corpus uses most stands for it. Texts are rewritten by a
multi-pattern automaton, from left to right, the longest pattern first, until
nothing changes, and composed again. Characters that show as nothing are the
class of the empty string.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions.text import WIDE_WHITE
from knotwork.session import cut

# Letters of one shape that the table of confusables gives another shape or none, by code point.
SAME_SHAPE = {"l": "04CF", "Q": "051A"}
#: Decompositions that a reader sees: styled, raised, lowered and enclosed characters.
_STYLED = frozenset("font super sub circle square fraction initial medial final isolated vertical small".split())
#: Format characters that are seen: marks before numbers and the like.
_SEEN_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
_NOTHING = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
_JOINER = "‍"
# People and what a joiner adds to them; there the joiner is seen.
_PEOPLE = (0x1F468, 0x1F469, 0x1F9D1)
_SKINS = (None, *range(0x1F3FB, 0x1F400))
_ADDED = (0x2695, 0x2696, 0x2708, 0x2764, 0x1F33E, 0x1F373, 0x1F37C, 0x1F384, 0x1F393, 0x1F3A4, 0x1F3A8, 0x1F3EB, 0x1F3ED, *range(0x1F466, 0x1F46A), 0x1F4BB, 0x1F4BC, 0x1F527, 0x1F52C, 0x1F680, 0x1F692, 0x1F91D, *range(0x1F9AF, 0x1F9B4), 0x1F9BC, 0x1F9BD)


class Classes:
    """Union-find over strings. Classes of two different printable ASCII characters are never united."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}
        self.plain: dict[str, str] = {}

    def find(self, s: str) -> str:
        root = s
        while self.parent.setdefault(root, root) != root:
            root = self.parent[root]
        while self.parent[s] != root:
            self.parent[s], s = root, self.parent[s]
        return root

    def unite(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        x, y = (self.plain.get(r, r if len(r) == 1 and "!" <= r <= "~" else None) for r in (a, b))
        if a == b or x and y:
            return
        self.parent[max(a, b)] = min(a, b)
        if x or y:
            self.plain[min(a, b)] = x or y

    def groups(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for s in self.parent:
            out.setdefault(self.find(s), []).append(s)
        return out


def _decomposition(c: str) -> tuple[str, str]:
    d = unicodedata.decomposition(c)
    if not d:
        return "", ""
    tag, _, rest = d.rpartition("> ")
    return tag.lstrip("<"), "".join(chr(int(x, 16)) for x in rest.split())


def _joined_letters(c: str, parts: str) -> bool:
    kind = unicodedata.category(c)
    return not set(parts) & {"ſ", "ʼ"} and parts.isalpha() and (kind == "Nl" or kind[0] == "L" and len(parts) > 1)


def _kind(c: str) -> tuple:
    """What a reader tells apart although the shapes are alike: case, the value of a digit, letter or mark; () for what is in no class."""
    kind = unicodedata.category(c)
    if kind in ("Lu", "Lt"):
        return ("upper",)
    if kind == "Ll":
        return ("lower",)
    if kind == "Lo":
        return ("letter",)
    if kind == "Nd":
        return "digit", unicodedata.digit(c)
    if kind == "Lm" or kind in ("Po", "Ps", "Pe", "Pc", "Sm", "Sc", "Sk"):
        return ("mark",)
    return ()


def _words(c: str) -> set[str]:
    return set(unicodedata.name(c, "").split()) - {"SIGN", "MARK", "LETTER", "MODIFIER", "ACCENT", "FULL", "LEFT", "RIGHT", "SMALL", "CAPITAL"}


def confusables(spark: SparkSession) -> tuple[dict[str, str], set[str]]:
    """(every code point that the Unicode table of confusables knows, with its skeleton; letters with a soft dot).

    One call of the JVM's Unicode library; it doesn't depend on data.
    """
    icu = spark._jvm.com.ibm.icu.text
    points = [chr(c) for c in range(0x21, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and not 0xAC00 <= c < 0xD7A4 and unicodedata.category(chr(c)) not in ("Cn", "Co", "Cc", "Cf", "Zs", "Zl", "Zp")]
    points = [c for c in points if not unicodedata.name(c, "").startswith(("CJK UNIFIED", "TANGUT", "EGYPTIAN"))]
    skeletons = icu.SpoofChecker.Builder().build().getSkeleton("\n".join(points)).split("\n")
    dotted = icu.UnicodeSet("[:Soft_Dotted:]")
    return dict(zip(points, skeletons, strict=True)), {chr(dotted.charAt(i)) for i in range(dotted.size())}


def _by_shape(u: Classes, skeletons: dict[str, str], dotted: set[str]) -> None:
    """Unites code points of one skeleton that differ in nothing that a reader sees.

    Printable ASCII characters are never alike. Accents are left out, as the
    table takes different ones for alike; so are dashes and quotation marks,
    which have shapes of their own, and styled characters.
    """
    families: dict[tuple, dict[tuple, list[str]]] = {}
    listed = {chr(int(o, 16)) for others in SAME_SHAPE.values() for o in others.split()}
    for c, skeleton in skeletons.items():
        kind = _kind(c)
        if kind and c not in listed and unicodedata.is_normalized("NFD", c) and _decomposition(c)[0] not in _STYLED:
            dot = unicodedata.normalize("NFKD", c)[0] in dotted
            families.setdefault((skeleton, dot), {}).setdefault(kind, []).append(c)
    for family in families.values():
        letters = family.pop(("letter",), [])
        cased = [k for k in (("upper",), ("lower",)) if k in family]
        # a letter without case is alike to the cased ones where only one case has the shape
        family.setdefault(cased[0] if len(cased) == 1 else ("letter",), []).extend(letters)
        for members in family.values():
            plain = [c for c in members if c.isascii()]
            for c in members:
                if c.isascii():
                    continue
                if len(plain) > 1:
                    named = [p for p in plain if _words(p) & _words(c)]
                    if len(named) == 1:
                        u.unite(named[0], c)
                else:
                    u.unite(members[0], c)


_CLASSES: tuple[list[list[str]], str] | None = None


def look_alikes(spark: SparkSession) -> tuple[list[list[str]], str]:
    """(classes of two and more decomposed strings, characters that show as nothing); a few thousand, whatever the data."""
    global _CLASSES
    if _CLASSES is not None:
        return _CLASSES
    u = Classes()
    _by_shape(u, *confusables(spark))
    for s, others in SAME_SHAPE.items():
        for o in others.split():
            u.unite(s, chr(int(o, 16)))
    for h in (0x2010, 0x2011):  # hyphens
        u.unite("-", chr(h))
    white = [chr(c) for c in (*range(9, 14), *range(0x1C, 0x20), *WIDE_WHITE)]
    for w in [*white, "\r\n"]:
        u.unite(" ", w)
    nothing = []
    for code in range(0xA0, sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4:
            continue
        c = chr(code)
        if unicodedata.category(c) == "Cf" and code not in _SEEN_FORMAT or code in _NOTHING:
            nothing.append(c)
            continue
        tag, parts = _decomposition(c)
        if not parts or c in white:
            continue
        if tag in ("wide", "narrow", "noBreak") or tag == "compat" and (_joined_letters(c, parts) or c == "µ"):
            u.unite(c, unicodedata.normalize("NFD", parts))
    _CLASSES = [sorted(g) for g in u.groups().values() if len(g) > 1], "".join(nothing)
    return _CLASSES


def _tally(groups: list[list[str]]):
    """(member, n): how often the decomposed rows use each member of a class."""
    every = [m for g in groups for m in g]
    single, longer = [m for m in every if len(m) == 1], [m for m in every if len(m) > 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ascii_longer = [m for m in longer if m.isascii()]
        wide = ahocorasick.Automaton()
        for m in longer:
            if not m.isascii():
                wide.add_word(m, m)
        wide.make_automaton()
        codes = np.zeros(sys.maxunicode + 1, dtype=np.int64)
        total: Counter = Counter()
        for b in batches:
            texts = [t if t.isascii() else unicodedata.normalize("NFD", t) for t in b.column(0).to_pylist() if t]
            whole = "\x00".join(texts)
            points = np.frombuffer(whole.encode("utf-32-le", "replace"), dtype=np.uint32)
            found = np.bincount(points, minlength=0)
            codes[: len(found)] += found
            for m in ascii_longer:
                total[m] += whole.count(m)
            if len(wide):
                for t in texts:
                    if not t.isascii():
                        for _, m in wide.iter_long(t):
                            total[m] += 1
        for m in single:
            total[m] += int(codes[ord(m)])
        some = [(m, n) for m, n in total.items() if n]
        yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], ["member", "n"])

    return run


def representatives(df: DataFrame, text: str) -> dict[str, str]:
    """Every member that is rewritten, and the member of its class that the corpus uses most.

    As many rows come to the driver as there are members in use, whatever the
    size of the corpus. Of members used equally often an ASCII one stands
    for the class, then separate letters before joined ones, then the one with
    the lesser code points.
    """
    groups, nothing = look_alikes(df.sparkSession)
    used = {
        r["member"]: r["n"]
        for r in df.select(F.col(text).alias("t")).where(F.col("t").isNotNull()).mapInArrow(_tally(groups), "member string, n long").groupBy("member").agg(F.sum("n").alias("n")).collect()
    }
    out = dict.fromkeys(nothing, "")
    for g in groups:
        best = min(g, key=lambda m: (-used.get(m, 0), not m.isascii(), len(m) if m.isascii() else -len(m), m))
        out.update((m, best) for m in g if m != best)
    return out


#: A run of anything but printable ASCII, with the character before it: no pattern reaches out of it.
_ODD = re.compile(r"[ -~]?[^ -~]+")
#: Rewritten runs that a task keeps.
KEEP_PARTS = 200_000


class Rewriter:
    """Rewrites texts by rules; runs of characters that no rule touches are passed over."""

    def __init__(self, rules: dict[str, str]) -> None:
        self.automaton = ahocorasick.Automaton()
        for pattern, to in rules.items():
            self.automaton.add_word(pattern, (len(pattern), to))
        for person in _PEOPLE:
            for skin in _SKINS:
                start = chr(person) + (chr(skin) if skin else "") + _JOINER
                for x in _ADDED:
                    self.automaton.add_word(start + chr(x), (len(start) + 1, start + chr(x)))
        self.automaton.make_automaton()
        self.local = all(_ODD.fullmatch(p) for p in rules)
        self.known: dict[str, str] = {}

    def once(self, text: str) -> str:
        parts, at = [], 0
        for end, (size, to) in self.automaton.iter_long(text):
            start = end + 1 - size
            if start > at:
                parts.append(text[at:start])
            parts.append(to)
            at = end + 1
        if not parts:
            return text
        parts.append(text[at:])
        return "".join(parts)

    def settled(self, text: str) -> str:
        """Rewritten until nothing changes: what one pass removes may bring a letter and its mark together."""
        text = unicodedata.normalize("NFD", text)
        while True:
            new = unicodedata.normalize("NFD", self.once(text))
            if new == text:
                return unicodedata.normalize("NFC", text)
            text = new

    def _part(self, m: re.Match) -> str:
        part = m.group()
        found = self.known.get(part)
        if found is None:
            if len(self.known) > KEEP_PARTS:
                self.known.clear()
            found = self.known[part] = self.settled(part)
        return found

    def __call__(self, text: str) -> str:
        return _ODD.sub(self._part, text) if self.local else self.settled(text)


def uniform_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and ``uniform``: the text in its one form. A null text stays null, an empty one empty; repeated rows stay."""
    rules = representatives(df, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = Rewriter(rules)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([None if t is None else rewrite(t) for t in b.column("t").to_pylist()], pa.string())], ["key", "uniform"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, uniform string").withColumnRenamed("key", key)


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _looks(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, look, own: digests of the uniform and of the unchanged text; only rows that show something."""
    rules = representatives(df, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = Rewriter(rules)
        for b in batches:
            keys, looks, own = [], [], []
            for k, t in zip(b.column("key").to_pylist(), b.column("t").to_pylist()):
                if t:
                    uniform = rewrite(t)
                    if uniform.strip():
                        keys.append(k)
                        looks.append(_digest(uniform))
                        own.append(_digest(t))
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field("key").type), pa.array(looks, pa.binary()), pa.array(own, pa.binary())], ["key", "look", "own"])

    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, look binary, own binary")


def _mixed(looks: DataFrame) -> DataFrame:
    """Looks that stand for more than one string."""
    return looks.groupBy("look").agg(F.min("own").alias("a"), F.max("own").alias("b"), F.min("key").alias("class_id")).where(F.col("a") < F.col("b")).select("look", "class_id")


def look_alike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """id_a < id_b of every two rows whose texts look the same and are not the same string.

    Texts that are null, empty or show nothing are no cases, nor are rows
    without a key. Only looks with more than one string behind them meet.
    """
    looks = cut(_looks(df, key, text).distinct())
    some = looks.join(_mixed(looks).select("look"), "look")
    a = some.select("look", F.col("key").alias("id_a"), F.col("own").alias("own_a"))
    b = some.select("look", F.col("key").alias("id_b"), F.col("own").alias("own_b"))
    return a.join(b, "look").where((F.col("id_a") < F.col("id_b")) & (F.col("own_a") != F.col("own_b"))).select("id_a", "id_b").distinct()


def look_alike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, class_id, n_links: rows of looks with more than one string, the least key of the look, and how many rows of it have another string."""
    looks = cut(_looks(df, key, text).distinct())
    per = looks.groupBy("look", "own").agg(F.count(F.lit(1)).alias("same"))
    whole = per.groupBy("look").agg(F.sum("same").alias("all"))
    return (
        looks.join(_mixed(looks), "look")
        .join(per, ["look", "own"])
        .join(whole, "look")
        .select(F.col("key").alias(key), "class_id", (F.col("all") - F.col("same")).alias("n_links"))
    )
