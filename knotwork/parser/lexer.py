"""Source text to tokens, each with a one-character kind, so that a run of kinds is a string.

Runs of ordinary tokens are cut by one compiled pattern; only templates, regular
expressions and JSX need state. Templates and JSX elements become one token each
that holds the token lists of their embedded expressions.
"""

from __future__ import annotations

import re

#: Reserved words, words with a meaning in some places, and punctuators.
RESERVED = (
    "break case catch class const continue debugger default delete do else enum export extends false finally for "
    "function if import in instanceof new null return super switch this throw true try typeof var void while with"
).split()
CONTEXTUAL = (
    "abstract accessor any as asserts async await bigint boolean constructor declare from get global implements infer "
    "interface is keyof let module namespace never number object of out override private protected public readonly "
    "require satisfies set static string symbol type undefined unique unknown using yield"
).split()
LONG = "... => == != === !== ++ -- && || ?? ?. += -= *= /= %= **= **  <<= <<  <= &= |= ^= &&= ||= ??=".split()

KIND: dict[str, str] = {c: c for c in "(){}[];,<>=+-*/%&|^!~?:.@#"}
for _i, _w in enumerate([*RESERVED, *CONTEXTUAL, *LONG]):
    KIND[_w] = chr(0x100 + _i)
NEWLINE, NAME, NUMBER, STRING, TEMPLATE, REGEX, JSX, PRIVATE, GLUED, BAD, END = "N", "a", "0", "'", "`", "r", "J", "p", "g", "\ufffd", "$"
#: Before what stands in the braces of a JSX child, and of JSX attributes.
CHILD, SPREAD_IN = "c", "d"
TEXT = {v: k for k, v in KIND.items()}
RESERVED_KINDS = frozenset(KIND[w] for w in RESERVED)
CONTEXTUAL_KINDS = frozenset(KIND[w] for w in CONTEXTUAL)
NAME_LIKE = CONTEXTUAL_KINDS | {NAME}
#: A slash after one of these divides; after anything else it opens a regular expression.
_OPERAND = frozenset(NAME_LIKE | {NUMBER, STRING, TEMPLATE, REGEX, JSX, PRIVATE, ")", "]", "}"} | {KIND[w] for w in "this super null true false ++ --".split()})

#: A parenthesis after one of these is the head of a statement; a brace after one of these opens no block.
_HEADS = frozenset(KIND[w] for w in "if while for with".split())
_BEFORE_OBJECT = frozenset("=([,?!&|+-*/%^~<.") | {KIND[w] for w in (
    "return throw case typeof void delete in instanceof new yield await default import export ... == != === !== && || ?? += -= *= /= %= **= ** <<= << <= &= |= ^= &&= ||= ??=".split())}

_ID = r"(?:[A-Za-z_$]|[^\x00-\x7f\s\u2028\u2029\ufeff]|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))(?:[\w$]|[^\x00-\x7f\s\u2028\u2029\ufeff]|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))*+"
_STR = r"'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*+'|\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*+\""
_COMMENT = r"//[^\n\r\u2028\u2029]*+|/\*(?:[^*]|\*(?!/))*+\*/"
_NUM = (
    r"0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?|0[bB][01]+(?:_[01]+)*n?"
    r"|(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?n?"
)
_PUNCT = r"\.\.\.|=>|===?|!==?|\*\*=?|\+\+|--|<<=?|<=|&&=?|\|\|=?|\?\?=?|\?\.(?!\d)|[+\-*%&|^]=|>(?=[>=])|[(){}\[\];,<>=+\-*%&|^!~?:.@]"
#: One ordinary token. Blanks and comments without a line end give nothing, with one they give a line end.
_TOKEN = re.compile(
    rf"(?:[ \t\f\v\xa0\ufeff]|//[^\n\r\u2028\u2029]*+|/\*(?:[^*\n\r]|\*(?!/))*+\*/)*+"
    rf"((?:[\n\r\u2028\u2029]|/\*(?:[^*]|\*(?!/))*+\*/)(?:\s|\ufeff|{_COMMENT})*+|{_ID}|{_PUNCT}|{_STR}|(?:{_NUM})(?![\w$])|#{_ID}|$|.)",
    re.S,
)
#: As many ordinary tokens as there are; stops before a template, a slash that is no comment, and for JSX a '<'.
_RUN = {
    (False, False): re.compile(rf"(?:[^`/'\"]++|{_COMMENT}|{_STR})*+"),
    (False, True): re.compile(rf"(?:[^`/'\"{{}}]++|{_COMMENT}|{_STR})*+"),
    (True, False): re.compile(rf"(?:[^`/'\"<]++|{_COMMENT}|{_STR})*+"),
    (True, True): re.compile(rf"(?:[^`/'\"<{{}}]++|{_COMMENT}|{_STR})*+"),
}
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029]|\[(?:[^\]\\\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029])*+\])++/([A-Za-z0-9_$]*)")
_PATTERN_PART = re.compile(r"\\.|\[(?:[^\]\\]|\\.)*+\]|\((?:\?(?:[:=!]|<[=!]|<[^>]*>|[a-z-]+:))?|.", re.S)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+")
_JSX_OPEN = re.compile(r"<\s*(?:[A-Za-z_$>])")
_GENERIC_ARROW = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\s+[^>/]*[,>]\s*\(|=[^>]*>\s*\()")
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$-]*(?:\s*:\s*[A-Za-z_$][\w$-]*|(?:\s*\.\s*[A-Za-z_$][\w$-]*)+)?")
_JSX_TEXT = re.compile(r"[^{}<>]*+")
_SPACE = re.compile(rf"(?:\s|\ufeff|{_COMMENT})*+")
_JSX_STRING = re.compile(r"'[^']*'|\"[^\"]*\"")
_MARKER = re.compile(r"^(?:<{7}|>{7}|={7}(?![=])|\|{7})", re.M)


class Broken(Exception):
    """The text is not what the grammar allows."""


class Tokens:
    """kinds: one character for each token and ``END``; values: the texts; inner: token lists by place."""

    __slots__ = ("kinds", "values", "inner", "bad", "jsx", "starts", "paired")

    def __init__(self) -> None:
        self.kinds, self.values, self.inner, self.bad, self.jsx, self.starts = "", [], {}, False, False, None
        self.paired = None


class _Kinds(dict):
    """Kind of a token text; names seen are kept, up to a bound."""

    def __missing__(self, text: str) -> str:
        c = text[0]
        if c in "\n\r\u2028\u2029":
            return NEWLINE
        if c == "/":
            return NEWLINE if len(text) > 3 else BAD
        if c in "'\"":
            return STRING if len(text) > 1 else BAD
        if c.isdigit() or c == "." and len(text) > 1:
            return NUMBER if _sound_number(text) else BAD
        if c == "#":
            return PRIVATE if len(text) > 1 else BAD
        if c.isalpha() or c in "_$\\" or ord(c) > 127:
            if c not in "_$\\" and not c.isalpha() and not c.isidentifier():
                return BAD
            if "\\" not in text and not text.replace("$", "_").isidentifier() and not _odd_name(text):
                return BAD
            if len(self) > 200_000:
                self.clear()
                self.update(KIND)
            self[text] = NAME
            return NAME
        return BAD


def _odd_name(text: str) -> bool:
    return ("x" + text.replace("$", "_").replace("\u200c", "").replace("\u200d", "")).isidentifier()


def _sound_number(text: str) -> bool:
    if len(text) > 1 and text[0] == "0" and text[1] in "0123456789":
        return "_" not in text and "n" not in text
    if text[-1] == "n":
        return text[1:2] in "xXoObB" and len(text) > 2 or "." not in text and "e" not in text and "E" not in text
    return True


_KINDS = _Kinds(KIND)
_KINDS[">"] = ">"


def tokenise(src: str, jsx: bool, places: bool = False) -> Tokens:
    """The whole text; ``bad`` is set where a token can't be cut. With places, ``starts`` has where each token begins."""
    out = Tokens()
    out.starts = [] if places else None
    pos = 0
    if src.startswith("\ufeff"):
        pos = 1
    if src.startswith("#!", pos):
        m = re.compile(r"[^\n\r]*").match(src, pos)
        pos = m.end()
    end = _scan(src, pos, jsx, out, False)
    if end != len(src):
        out.bad = True
    return out


def _last(kinds: list[str]) -> str:
    for run in reversed(kinds):
        for c in reversed(run):
            if c != NEWLINE:
                return c
    return ""


class _Brackets:
    """Brackets among the tokens so far, each kind looked at once; tells what the last closed one was."""

    def __init__(self) -> None:
        self.open: list[tuple[str, bool | None]] = []
        self.run = self.before = 0
        self.last, self.last2 = "", ""
        self.statement = False

    def ends_statement(self, kinds: list[str]) -> bool:
        """Whether the last token closes the head of a statement, or a block: a regular expression may follow, no division."""
        for run in kinds[self.run :]:
            for c in run:
                if c == NEWLINE:
                    continue
                if c == "(":
                    head = self.last in _HEADS and self.last2 not in (".", KIND["?."]) or self.last == KIND["await"] and self.last2 == KIND["for"]
                    self.open.append((c, head))
                elif c == "{":
                    # after a colon it is a block of a label or case, or what a conditional gives: a line end tells
                    in_block = not self.open or self.open[-1] == ("{", True)
                    self.open.append((c, self.last not in _BEFORE_OBJECT if self.last != ":" else None if in_block else False))
                elif c == "[":
                    self.open.append((c, False))
                elif c in ")]}":
                    self.statement = self.open.pop()[1] if self.open else c == "}"
                self.last2, self.last = self.last, c
        self.run = len(kinds)
        return self.statement if self.statement is not None else kinds[-1][-1:] == NEWLINE


def _sound_pattern(body: str, flags: str) -> bool:
    """Groups of a regular expression are closed, and every quantifier has something to repeat."""
    if "v" in flags:
        return True
    depth, before = 0, "("
    for c in _PATTERN_PART.findall(body):
        if c[0] == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth < 0:
                return False
        elif c in "*+?" and before in ("(", "|"):
            return False
        before = "(" if c[0] == "(" else c
    return depth == 0


def _scan(src: str, pos: int, jsx: bool, out: Tokens, inside: bool) -> int:
    """Tokens from pos into out, to the end or, inside an embedded expression, to its closing brace; where it stopped."""
    n = len(src)
    values: list[str] = []
    kinds: list[str] = []
    depth = 0
    run = _RUN[jsx, inside]
    lookup = _KINDS.__getitem__
    starts = out.starts
    brackets = _Brackets()
    while True:
        end = run.match(src, pos).end()
        if end > pos:
            found = _TOKEN.findall(src, pos, end)
            while found and not found[-1]:  # blanks at the end of the run
                found.pop()
            some = [lookup(t) for t in found]
            if ">" in found:
                some = _glue(src, pos, end, found, some)
            values += found
            kinds.append("".join(some))
            if starts is not None:
                starts += [m.start(1) for m in _TOKEN.finditer(src, pos, end)][: len(found)]
            pos = end
        if pos >= n:
            break
        c = src[pos]
        if starts is not None and not (c == "}" and depth == 0):
            starts.append(pos)
        if c == "`":
            parts: list[Tokens] = []
            pos = _template(src, pos + 1, jsx, parts, out)
            out.inner[len(values)] = parts
            values.append("`")
            kinds.append(TEMPLATE)
        elif c == "/":
            last = _last(kinds)
            m = None if last in _OPERAND and not (last in (")", "}") and brackets.ends_statement(kinds)) else _REGEX.match(src, pos)
            if m:
                flags = m.group(1)
                sound = _sound_pattern(src[pos + 1 : m.start(1) - 1], flags) and len(set(flags)) == len(flags) and not set(flags) - set("dgimsuvy") and not {"u", "v"} <= set(flags)
                values.append("/r/")
                kinds.append(REGEX if sound else BAD)
                pos = m.end()
            elif src.startswith("/*", pos):  # a comment that never ends
                out.bad = True
                pos = n
            else:
                t = "/=" if src.startswith("/=", pos) else "/"
                values.append(t)
                kinds.append(KIND[t])
                pos += len(t)
        elif c == "<":
            last = _last(kinds)
            if last not in _OPERAND and _JSX_OPEN.match(src, pos) and not _GENERIC_ARROW.match(src, pos):
                parts = []
                at = _element(src, pos, jsx, parts, out)
                out.inner[len(values)] = parts
                values.append("<J>")
                kinds.append(JSX)
                out.jsx = True
                pos = at
            else:
                t = "<<=" if src.startswith("<<=", pos) else "<<" if src.startswith("<<", pos) else "<=" if src.startswith("<=", pos) else "<"
                values.append(t)
                kinds.append(KIND[t])
                pos += len(t)
        elif c == "{":
            depth += 1
            values.append(c)
            kinds.append(c)
            pos += 1
        elif c == "}":
            if depth == 0:
                break
            depth -= 1
            values.append(c)
            kinds.append(c)
            pos += 1
        else:  # a quote that opens a string without an end
            out.bad = True
            values.append(c)
            kinds.append(BAD)
            pos += 1
    out.values = values
    out.kinds = "".join(kinds) + END
    if BAD in out.kinds:
        out.bad = True
    if len(out.kinds) != len(values) + 1 or NEWLINE + NEWLINE in out.kinds:
        _squeeze(out)
    return pos


def _glue(src: str, pos: int, end: int, found: list[str], some: list[str]) -> list[str]:
    """A '>' that touches a following '>' or '=' gets a kind of its own."""
    if ">>" not in src[pos:end] and ">=" not in src[pos:end]:
        return some
    for i, m in enumerate(_TOKEN.finditer(src, pos, end)):
        if i < len(found) and found[i] == ">" and src[m.end() : m.end() + 1] in (">", "="):
            some[i] = GLUED
    return some


def _squeeze(out: Tokens) -> None:
    """One line end where runs left several."""
    values, kinds, inner, starts = [], [], {}, []
    for i, (v, k) in enumerate(zip(out.values, out.kinds)):
        if k == NEWLINE and kinds and kinds[-1] == NEWLINE:
            continue
        if i in out.inner:
            inner[len(values)] = out.inner[i]
        values.append(v)
        kinds.append(k)
        if out.starts is not None:
            starts.append(out.starts[i])
    if out.starts is not None:
        out.starts = starts
    out.values, out.kinds, out.inner = values, "".join(kinds) + END, inner


def _embedded(src: str, pos: int, jsx: bool, parts: list[Tokens], out: Tokens) -> int:
    """The expression from pos to its closing brace; the place after it."""
    sub = Tokens()
    sub.starts = None if out.starts is None else []
    pos = _scan(src, pos, jsx, sub, True)
    parts.append(sub)
    out.bad |= sub.bad
    out.jsx |= sub.jsx
    if pos >= len(src):
        out.bad = True
        return pos
    return pos + 1


def _template(src: str, pos: int, jsx: bool, parts: list[Tokens], out: Tokens) -> int:
    while True:
        pos = _TEMPLATE.match(src, pos).end()
        if pos >= len(src):
            out.bad = True
            return pos
        if src[pos] == "`":
            return pos + 1
        pos = _embedded(src, pos + 2, jsx, parts, out)


def _blank(src: str, pos: int) -> int:
    return _SPACE.match(src, pos).end()


def _element(src: str, pos: int, jsx: bool, parts: list[Tokens], out: Tokens) -> int:
    """A JSX element or fragment from its '<'; the place after it. Its expressions go to parts in order."""
    n = len(src)
    open_tags: list[str] = []
    while True:
        if pos >= n:
            out.bad = True
            return n
        if src[pos] != "<":
            at = _JSX_TEXT.match(src, pos).end()
            if at >= n or src[at] in ">}":
                out.bad = True
                return n
            pos = at
            if src[pos] == "{":
                pos = _embedded(src, pos + 1, jsx, parts, out)
                parts[-1].values.insert(0, "{")
                parts[-1].kinds = CHILD + parts[-1].kinds
                parts[-1].inner = {k + 1: v for k, v in parts[-1].inner.items()}
                continue
            if src[pos] != "<":
                continue
        pos = _blank(src, pos + 1)
        closing = src.startswith("/", pos)
        if closing:
            pos = _blank(src, pos + 1)
        m = _JSX_NAME.match(src, pos)
        name = re.sub(r"\s+", "", m.group()) if m else ""
        pos = _blank(src, m.end() if m else pos)
        if closing:
            if not open_tags or open_tags.pop() != name or not src.startswith(">", pos):
                out.bad = True
                return n
            pos += 1
        else:
            alone = False
            if name and src.startswith("<", pos):  # type arguments of a component
                m = re.compile(r"<[^<>(){};]*>").match(src, pos)
                if not m:
                    out.bad = True
                    return n
                pos = _blank(src, m.end())
            while True:
                if pos >= n:
                    out.bad = True
                    return n
                if src[pos] == ">":
                    pos += 1
                    break
                if src[pos] == "/" and name:
                    pos = _blank(src, pos + 1)
                    if not src.startswith(">", pos):
                        out.bad = True
                        return n
                    pos += 1
                    alone = True
                    break
                if src[pos] == "{" and name:
                    pos = _embedded(src, pos + 1, jsx, parts, out)
                    parts[-1].values.insert(0, "{...")
                    parts[-1].kinds = SPREAD_IN + parts[-1].kinds
                    parts[-1].inner = {k + 1: v for k, v in parts[-1].inner.items()}
                    pos = _blank(src, pos)
                    continue
                m = _JSX_NAME.match(src, pos) if name else None
                if not m or "." in m.group():
                    out.bad = True
                    return n
                pos = _blank(src, m.end())
                if src.startswith("=", pos):
                    pos = _blank(src, pos + 1)
                    s = _JSX_STRING.match(src, pos)
                    if s:
                        pos = s.end()
                    elif src.startswith("{", pos):
                        pos = _embedded(src, pos + 1, jsx, parts, out)
                    elif _JSX_OPEN.match(src, pos):
                        pos = _element(src, pos, jsx, parts, out)
                    else:
                        out.bad = True
                        return n
                    pos = _blank(src, pos)
            if not alone:
                open_tags.append(name)
        if not open_tags:
            return pos
