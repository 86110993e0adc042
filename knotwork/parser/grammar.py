"""Recursive-descent parser over token kinds, with a memory of statement shapes.

Whether a statement parses depends only on the kinds of its tokens, the kind of
the token after it and a few flags. So each logical line (up to a line end at
its own bracket depth) that parsed exactly is remembered by its kinds, and met
again it is skipped. The memory is bounded and never changes a result.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left, bisect_right
from functools import wraps

from knotwork.parser.lexer import (
    CHILD, CONTEXTUAL_KINDS, END, GLUED, JSX, KIND, NAME, NAME_LIKE, NEWLINE, NUMBER, PRIVATE, REGEX, RESERVED_KINDS, SPREAD_IN, STRING, TEMPLATE, Broken, Tokens, tokenise,
)

#: Grammars: type syntax and JSX.
GRAMMARS = {"typescript": (True, False), "tsx": (True, True), "javascript": (False, False), "jsx": (False, True)}
_OF_EXTENSION = {".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "jsx"}

_K = KIND
ARROW, SPREAD, OPT = _K["=>"], _K["..."], _K["?."]
ASSIGN = frozenset("=") | {_K[o] for o in "+= -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split()}
_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, "<=": 8, "instanceof": 8, "in": 8, "<<": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
BINARY = {_K[o]: p for o, p in _BINARY.items()} | {">": 8, GLUED: 8}
UNARY = frozenset("+-!~") | {_K[w] for w in ("delete", "void", "typeof")}
UPDATE = frozenset({_K["++"], _K["--"]})
AS, SATISFIES, AWAIT, YIELD, ASYNC, OF, IN = (_K[w] for w in "as satisfies await yield async of in".split())
FUNCTION, CLASS, NEW, IMPORT, EXPORT, SUPER, THIS, EXTENDS = (_K[w] for w in "function class new import export super this extends".split())
VAR, LET, CONST, IF, ELSE, FOR, WHILE, DO, RETURN, BREAK, CONTINUE, THROW, TRY, CATCH, FINALLY, SWITCH, CASE, DEFAULT, DEBUGGER, WITH, ENUM, TYPEOF, VOID, USING = (
    _K[w] for w in "var let const if else for while do return break continue throw try catch finally switch case default debugger with enum typeof void using".split()
)
TYPE, INTERFACE, DECLARE, ABSTRACT, NAMESPACE, MODULE, GLOBAL, IMPLEMENTS, IS, ASSERTS, INFER, KEYOF, READONLY, UNIQUE, GET, SET, STATIC, ACCESSOR, FROM, REQUIRE, OUT, OVERRIDE = (
    _K[w] for w in "type interface declare abstract namespace module global implements is asserts infer keyof readonly unique get set static accessor from require out override".split()
)
LITERAL = frozenset({NUMBER, STRING, REGEX, _K["null"], _K["true"], _K["false"]})
MODIFIERS = frozenset(_K[w] for w in "public private protected static readonly abstract override declare accessor async".split())
PARAM_MODIFIERS = frozenset(_K[w] for w in "public private protected readonly override".split())
WORDS = NAME_LIKE | RESERVED_KINDS
_NOT_NAMES = frozenset()
_BRACKETS = re.compile(r"[(){}\[\]N$]")
_SHIFT_ASSIGN = re.compile(f"{GLUED}{{2,3}}=")
_CLOSES = {")": "(", "]": "[", "}": "{"}

#: Statement shapes kept, and the longest one worth keeping.
MEMORY, LONGEST = 300_000, 600
_seen: dict[tuple, int] = {}

TOP, IN_FUNCTION, IN_LOOP, IN_SWITCH, AMBIENT, BLOCK = 1, 2, 4, 8, 16, 32

OTHER = ("other", None)


class Parser:
    def __init__(self, tokens: Tokens, ts: bool, collect: bool = False) -> None:
        self.k, self.v, self.inner = tokens.kinds, tokens.values, tokens.inner
        self.tokens = tokens
        self.ts, self.collect = ts, collect
        self.i = 1 if self.k[0] == NEWLINE else 0
        self.typed = False
        self.calls: list[str] = []
        self.functions: list[tuple] = []
        self.imports: list[tuple] = []
        self.match: dict[int, int] = {}
        self.lines: dict[int, int] = {}
        self.tops: list[int] = []
        if tokens.paired is None:
            self._pair()
            tokens.paired = self.match, self.lines
        self.match, self.lines = tokens.paired

    def _pair(self) -> None:
        """Brackets by place, and logical lines: start to end at the same depth.

        When collecting, an unclosed bracket ends with the one around it or with
        the text, and one that closes nothing is passed over; tops has the line
        starts outside brackets.
        """
        k, match, lines = self.k, self.match, self.lines
        opened: list[int] = []
        held = dict.fromkeys("([{", 0)
        starts = [self.i]
        for m in _BRACKETS.finditer(k):
            c, at = m.group(), m.start()
            if c == NEWLINE:
                lines[starts[-1]] = at
                starts[-1] = at + 1
                if not opened:
                    self.tops.append(at + 1)
            elif c in "([{":
                opened.append(at)
                held[c] += 1
                starts.append(at + 2 if k[at + 1] == NEWLINE else at + 1)
            elif c != END:
                if not opened or k[opened[-1]] != _CLOSES[c]:
                    if not self.collect:
                        raise Broken
                    if not held[_CLOSES[c]]:
                        continue
                    while k[opened[-1]] != _CLOSES[c]:
                        held[k[opened[-1]]] -= 1
                        match[opened.pop()] = at - 1
                        lines.setdefault(starts.pop(), at)
                held[_CLOSES[c]] -= 1
                match[opened.pop()] = at
                lines.setdefault(starts.pop(), at)
        if opened:
            if not self.collect:
                raise Broken
            match.update(dict.fromkeys(opened, len(k) - 2))
        lines.setdefault(starts[-1], len(k) - 1)

    # -- moving

    def next(self) -> None:
        i = self.i + 1
        self.i = i + 1 if self.k[i : i + 1] == NEWLINE else i

    def after(self, i: int) -> int:
        i += 1
        return i + 1 if self.k[i : i + 1] == NEWLINE else i

    def fresh(self) -> bool:
        """A line end comes before the token here."""
        return self.i > 0 and self.k[self.i - 1] == NEWLINE

    def take(self, c: str) -> None:
        if self.k[self.i] != c:
            raise Broken
        self.next()

    def eat(self, c: str) -> bool:
        if self.k[self.i] == c:
            self.next()
            return True
        return False

    def peek(self) -> str:
        j = self.after(self.i)
        return self.k[j] if j < len(self.k) else END

    def name(self) -> str:
        if self.k[self.i] not in NAME_LIKE:
            raise Broken
        text = self.v[self.i]
        self.next()
        return text

    def semicolon(self) -> None:
        c = self.k[self.i]
        if c == ";":
            self.next()
        elif c != "}" and c != END and not self.fresh():
            raise Broken

    def mark(self) -> tuple:
        return self.i, len(self.calls), self.typed

    def back(self, to: tuple) -> None:
        self.i, n, self.typed = to
        del self.calls[n:]

    def attempt(self, rule, *args):
        to = self.mark()
        try:
            return rule(*args)
        except Broken:
            self.back(to)
            return None

    def uses_types(self) -> None:
        if not self.ts:
            raise Broken
        self.typed = True

    # -- statements

    def program(self) -> None:
        self.statements(TOP, END)

    def sound_statements(self) -> bool:
        """The program without the statements that have errors; after one it goes on at the next line outside brackets."""
        k, tops, sound = self.k, self.tops, True
        while k[self.i] != END:
            at, n = self.i, len(self.calls)
            try:
                if k[at] == "}":
                    raise Broken
                self.statement(TOP)
            except (Broken, IndexError):
                sound = False
                del self.calls[n:]
                self.no_conditional = False
                j = bisect_right(tops, max(at, self.i))
                if j == len(tops):
                    break
                self.i = tops[j]
        return sound

    def statements(self, ctx: int, end: str) -> None:
        k, lines, collect = self.k, self.lines, self.collect
        while True:
            i = self.i
            c = k[i]
            if c == end:
                return
            if c == END or c == "}":
                raise Broken
            if end == "}" and ctx & IN_SWITCH and c in (CASE, DEFAULT) and ctx & BLOCK:
                return
            stop = -1 if collect else lines.get(i, -1)
            if stop < 0 or stop - i > LONGEST:
                self.statement(ctx)
                continue
            past = stop + 1 if k[stop] == NEWLINE else stop
            key = (self.ts, ctx, k[i : past + 1])
            found = _seen.get(key)
            if found is not None:
                self.typed |= bool(found)
                self.i = past
                continue
            before, self.typed = self.typed, False
            self.statement(ctx)
            if self.i == past:
                if len(_seen) >= MEMORY:
                    _seen.clear()
                _seen[key] = int(self.typed)
            self.typed |= before

    def block(self, ctx: int) -> None:
        self.take("{")
        self.statements(ctx & ~TOP & ~BLOCK, "}")
        self.next()

    def statement(self, ctx: int, alone: bool = False) -> None:
        c = self.k[self.i]
        rule = _STATEMENTS.get(c)
        if rule is not None:
            if alone and c in (CLASS, CONST, IMPORT, EXPORT):
                raise Broken
            if rule(self, ctx):
                return
        if c in NAME_LIKE and self.peek() == ":":  # label
            self.next()
            self.next()
            self.statement(ctx, True)
            return
        self.expression()
        self.semicolon()

    def _empty(self, ctx: int) -> bool:
        self.next()
        return True

    def _block(self, ctx: int) -> bool:
        self.block(ctx)
        return True

    def _var(self, ctx: int) -> bool:
        c = self.k[self.i]
        if c == LET or c == USING:
            p = self.peek()
            if p not in NAME_LIKE and p not in "[{" or c == USING and (p not in NAME_LIKE or p in (OF, AS)):
                return False
        if c == CONST and self.peek() == ENUM:
            self.uses_types()
            self.next()
            return self._enum(ctx)
        self.next()
        self.declarators(ctx, c)
        self.semicolon()
        return True

    def declarators(self, ctx: int, c: str, loop: bool = False) -> None:
        while True:
            start = self.i
            simple = self.k[start] in NAME_LIKE
            label = self.v[start]
            self.binding()
            if self.k[self.i] == "!" and self.ts and not self.fresh():
                self.uses_types()
                self.next()
            self.annotation()
            if self.k[self.i] == "=":
                self.next()
                kind, where = self.assign(not loop)
                if simple and kind == "fn" and ctx & TOP and self.collect:
                    self.register(label, start, where)
            elif loop and self.k[self.i] in (IN, OF):
                return
            elif not loop and not ctx & AMBIENT and (c == CONST or c == USING or not simple):
                raise Broken
            if self.k[self.i] != ",":
                return
            self.next()

    def register(self, name: str, start: int, where: tuple) -> None:
        first, last = where
        end = self.i - 1
        while end > start and self.k[end] == NEWLINE:
            end -= 1
        self.functions.append((name, start, end, self.calls[first:last]))

    def _function(self, ctx: int) -> bool:
        start = self.i
        if self.k[start] == ASYNC:
            if self.peek() != FUNCTION or self.k[start + 1] == NEWLINE:
                return False
            self.next()
        self.next()
        self.eat("*")
        label = self.name()
        where = self.function_rest(ctx, True)
        if ctx & TOP and self.collect and where is not None:
            self.register(label, start, where[:2])
        elif self.collect and where is not None and not ctx & TOP:
            del self.calls[where[2] :]
        return True

    def function_rest(self, ctx: int = 0, declaration: bool = False):
        """Parameters, result type and body; (first, last) of the body's calls and where all began; None without a body."""
        began = len(self.calls)
        self.type_parameters()
        self.parameters()
        self.result_type()
        if declaration and self.k[self.i] != "{":
            self.uses_types()
            self.semicolon()
            return None
        first = len(self.calls)
        self.block(IN_FUNCTION)
        return first, len(self.calls), began

    def parameters(self) -> None:
        self.take("(")
        while self.k[self.i] != ")":
            self.decorators()
            while self.k[self.i] in PARAM_MODIFIERS and (self.peek() in NAME_LIKE or self.peek() in "{["):
                self.uses_types()
                self.next()
            rest = self.eat(SPREAD)
            if self.k[self.i] == THIS:
                self.uses_types()
                self.next()
            else:
                self.binding()
            if self.k[self.i] == "?":
                self.uses_types()
                self.next()
            self.annotation()
            if not rest and self.eat("="):
                self.assign()
            if self.k[self.i] == ")":
                break
            self.take(",")
            if rest:
                raise Broken
        self.next()

    def binding(self) -> None:
        c = self.k[self.i]
        if c in NAME_LIKE:
            self.next()
        elif c == "[":
            self.next()
            while self.k[self.i] != "]":
                if self.eat(","):
                    continue
                rest = self.eat(SPREAD)
                self.binding()
                if not rest and self.eat("="):
                    self.assign()
                if self.k[self.i] != "]":
                    self.take(",")
                    if rest:
                        raise Broken
            self.next()
        elif c == "{":
            self.next()
            while self.k[self.i] != "}":
                if self.eat(SPREAD):
                    self.name()
                else:
                    short = self.k[self.i] in NAME_LIKE
                    self.property_name()
                    if self.eat(":"):
                        self.binding()
                    elif not short:
                        raise Broken
                    if self.eat("="):
                        self.assign()
                if self.k[self.i] != "}":
                    self.take(",")
            self.next()
        else:
            raise Broken

    def property_name(self) -> None:
        c = self.k[self.i]
        if c == "[":
            self.next()
            self.assign()
            self.take("]")
        elif c in WORDS or c in (STRING, NUMBER, PRIVATE):
            self.next()
        else:
            raise Broken

    def annotation(self) -> None:
        if self.k[self.i] == ":":
            self.uses_types()
            self.next()
            self.type()

    def result_type(self) -> None:
        if self.k[self.i] == ":":
            self.uses_types()
            self.next()
            self.predicate()

    def predicate(self) -> None:
        c = self.k[self.i]
        if c == ASSERTS and (self.peek() in NAME_LIKE or self.peek() == THIS) and self.k[self.i + 1] != NEWLINE:
            self.next()
            self.next()
            if self.eat(IS):
                self.type()
            return
        if (c in NAME_LIKE or c == THIS) and self.peek() == IS and self.k[self.i + 1] != NEWLINE:
            self.next()
            self.next()
        self.type()

    def decorators(self) -> None:
        while self.k[self.i] == "@":
            self.next()
            if self.k[self.i] == "(":
                self.primary()
                continue
            self.name()
            while self.k[self.i] == ".":
                self.next()
                if self.k[self.i] not in WORDS and self.k[self.i] != PRIVATE:
                    raise Broken
                self.next()
            if self.k[self.i] == "(":
                self.arguments()

    def _decorated(self, ctx: int) -> bool:
        self.decorators()
        if self.k[self.i] == EXPORT:
            return self._export(ctx)
        if self.k[self.i] == ABSTRACT:
            self.uses_types()
            self.next()
        return self._class(ctx)

    def _class(self, ctx: int) -> bool:
        self.take(CLASS)
        if self.k[self.i] in NAME_LIKE and self.k[self.i] != IMPLEMENTS:
            self.next()
        self.class_rest(ctx)
        return True

    def class_rest(self, ctx: int = 0) -> None:
        self.type_parameters()
        if self.eat(EXTENDS):
            self.left_side()
            if self.k[self.i] in ("<",) and self.ts:
                self.type_arguments()
        if self.k[self.i] == IMPLEMENTS:
            self.uses_types()
            self.next()
            self.type()
            while self.eat(","):
                self.type()
        self.take("{")
        while self.k[self.i] != "}":
            if not self.eat(";"):
                self.member(ctx)
        self.next()

    def member(self, ctx: int) -> None:
        began = len(self.calls)
        self.decorators()
        if self.k[self.i] == STATIC and self.peek() == "{":
            self.next()
            self.block(IN_FUNCTION)
            return
        bodyless = bool(ctx & AMBIENT)
        while self.k[self.i] in MODIFIERS:
            p = self.peek()
            if p in "(=;}?!:<,":
                break
            if self.k[self.i + 1] == NEWLINE and self.k[self.i] in (ASYNC, ACCESSOR, DECLARE):
                break
            if self.k[self.i] not in (STATIC, ASYNC, ACCESSOR):
                self.uses_types()
                if self.k[self.i] in (ABSTRACT, DECLARE):
                    bodyless = True
            self.next()
        self.eat("*")
        if self.k[self.i] in (GET, SET) and (self.peek() in WORDS or self.peek() in (STRING, NUMBER, PRIVATE, "[")) and self.k[self.i + 1] != NEWLINE:
            self.next()
        if self.k[self.i] == "[" and self.ts and self.index_signature():
            self.semicolon()
            return
        self.property_name()
        if self.k[self.i] in "?!":
            self.uses_types()
            self.next()
        if self.k[self.i] in "(<":
            where = None
            self.type_parameters()
            self.parameters()
            self.result_type()
            if self.k[self.i] == "{":
                self.block(IN_FUNCTION)
            else:  # an overload or an abstract method
                self.uses_types()
                self.semicolon()
            del self.calls[began:]
            return where
        self.annotation()
        if self.eat("="):
            self.assign()
        self.semicolon()

    def index_signature(self) -> bool:
        """[key: type]: type"""
        i = self.after(self.i)
        j = self.after(i)
        if self.k[i] not in NAME_LIKE or self.k[j] != ":":
            return False
        self.uses_types()
        self.next()
        self.next()
        self.next()
        self.type()
        self.take("]")
        if self.k[self.i] == ":":
            self.next()
            self.type()
        return True

    def _if(self, ctx: int) -> bool:
        self.next()
        self.take("(")
        self.expression()
        self.take(")")
        self.statement(ctx & ~TOP & ~BLOCK, True)
        if self.eat(ELSE):
            self.statement(ctx & ~TOP & ~BLOCK, True)
        return True

    def _for(self, ctx: int) -> bool:
        self.next()
        self.eat(AWAIT)
        self.take("(")
        c = self.k[self.i]
        declared = c in (VAR, CONST) or c == LET and (self.peek() in NAME_LIKE or self.peek() in "[{") or c == USING and self.peek() in NAME_LIKE and self.peek() != OF
        if c == ";":
            pass
        elif declared:
            self.next()
            self.declarators(0, c, loop=True)
        else:
            kind, _ = self.assign(False, head=True)
            if self.k[self.i] in (OF, IN):
                if kind not in ("id", "mem", "obj", "arr", "cover"):
                    raise Broken
            else:
                if kind == "cover":
                    raise Broken
                while self.eat(","):
                    self.assign(False)
        if self.k[self.i] == OF:
            self.next()
            self.assign()
        elif self.k[self.i] == IN:
            self.next()
            self.expression()
        else:
            self.take(";")
            if self.k[self.i] != ";":
                self.expression()
            self.take(";")
            if self.k[self.i] != ")":
                self.expression()
        self.take(")")
        self.statement(ctx & ~TOP & ~BLOCK | IN_LOOP, True)
        return True

    def _while(self, ctx: int) -> bool:
        self.next()
        self.take("(")
        self.expression()
        self.take(")")
        self.statement(ctx & ~TOP & ~BLOCK | IN_LOOP, True)
        return True

    def _with(self, ctx: int) -> bool:
        self.next()
        self.take("(")
        self.expression()
        self.take(")")
        self.statement(ctx & ~TOP & ~BLOCK, True)
        return True

    def _do(self, ctx: int) -> bool:
        self.next()
        self.statement(ctx & ~TOP & ~BLOCK | IN_LOOP, True)
        self.take(WHILE)
        self.take("(")
        self.expression()
        self.take(")")
        self.eat(";")
        return True

    def _return(self, ctx: int) -> bool:
        if not ctx & IN_FUNCTION:
            raise Broken
        self.next()
        if not self.fresh() and self.k[self.i] not in (";", "}", END):
            self.expression()
        self.semicolon()
        return True

    def _jump(self, ctx: int) -> bool:
        c = self.k[self.i]
        self.next()
        if self.k[self.i] in NAME_LIKE and not self.fresh():
            self.next()
        elif not ctx & IN_LOOP and not (c == BREAK and ctx & IN_SWITCH):
            raise Broken
        self.semicolon()
        return True

    def _throw(self, ctx: int) -> bool:
        self.next()
        if self.fresh():
            raise Broken
        self.expression()
        self.semicolon()
        return True

    def _try(self, ctx: int) -> bool:
        self.next()
        self.block(ctx)
        some = False
        if self.eat(CATCH):
            some = True
            if self.eat("("):
                self.binding()
                self.annotation()
                self.take(")")
            self.block(ctx)
        if self.eat(FINALLY):
            some = True
            self.block(ctx)
        if not some:
            raise Broken
        return True

    def _switch(self, ctx: int) -> bool:
        self.next()
        self.take("(")
        self.expression()
        self.take(")")
        self.take("{")
        default = False
        while self.k[self.i] != "}":
            if self.eat(CASE):
                self.expression()
            else:
                self.take(DEFAULT)
                if default:
                    raise Broken
                default = True
            self.take(":")
            self.case_body(ctx & ~TOP & ~BLOCK | IN_SWITCH)
        self.next()
        return True

    def case_body(self, ctx: int) -> None:
        while self.k[self.i] not in (CASE, DEFAULT, "}"):
            self.statement(ctx)

    def _debugger(self, ctx: int) -> bool:
        self.next()
        self.semicolon()
        return True

    # -- modules

    def _import(self, ctx: int) -> bool:
        if self.peek() in "(.":
            return False
        if not ctx & (TOP | AMBIENT):
            raise Broken
        self.next()
        if self.k[self.i] == STRING:
            self.next()
            self.import_end()
            return True
        only_type = False
        if self.k[self.i] == TYPE and (self.peek() in NAME_LIKE or self.peek() in "{*"):
            j = self.after(self.after(self.i))
            if self.peek() != FROM or self.k[j] == FROM:
                self.uses_types()
                only_type = True
                self.next()
        found: list[tuple] = []
        if self.k[self.i] in NAME_LIKE:
            local = self.name()
            if self.k[self.i] == "=":  # import a = require("b")
                self.uses_types()
                self.next()
                self.name()
                if self.k[self.i] == "(":
                    self.arguments()
                else:
                    while self.eat("."):
                        self.next()
                self.semicolon()
                return True
            found.append((local, "default", True, False))
            if self.k[self.i] == ",":
                self.next()
                if self.k[self.i] not in "{*":
                    raise Broken
        if self.eat("*"):
            self.take(AS)
            found.append((self.name(), "*", False, True))
        elif self.eat("{"):
            while self.k[self.i] != "}":
                skip = False
                if self.k[self.i] == TYPE and self.peek() not in ",}" and not (self.peek() == AS and self.k[self.after(self.after(self.i))] not in (AS, ",", "}")):
                    self.uses_types()
                    skip = True
                    self.next()
                at = self.i
                if self.k[at] not in WORDS and self.k[at] != STRING:
                    raise Broken
                self.next()
                local = at
                if self.eat(AS):
                    local = self.i
                    self.name()
                elif self.k[at] not in NAME_LIKE:
                    raise Broken
                if not skip:
                    found.append((self.v[local], self.v[at], False, False))
                if self.k[self.i] != "}":
                    self.take(",")
            self.next()
        self.take(FROM)
        at = self.i
        self.take(STRING)
        source = self.v[at]
        self.import_end()
        if self.collect and not only_type:
            self.imports += [(local, imported, source[1:-1], d, n) for local, imported, d, n in found]
        return True

    def import_end(self) -> None:
        if self.k[self.i] == WITH or self.k[self.i] in NAME_LIKE and not self.fresh() and self.v[self.i] == "assert":
            self.next()
            self.primary()
        self.semicolon()

    def _export(self, ctx: int) -> bool:
        if not ctx & (TOP | AMBIENT):
            raise Broken
        self.next()
        c = self.k[self.i]
        if c == DEFAULT:
            self.next()
            self.decorators()
            c = self.k[self.i]
            if c == FUNCTION or c == ASYNC and self.peek() == FUNCTION and self.k[self.i + 1] != NEWLINE:
                j = self.after(self.after(self.i)) if c == ASYNC else self.after(self.i)
                j = self.after(j) if self.k[j] == "*" else j
                if self.k[j] == "(" or self.k[j] == "<":
                    if c == ASYNC:
                        self.next()
                    self.next()
                    self.eat("*")
                    self.function_rest(ctx, True)
                else:
                    self._function(ctx)
            elif c == CLASS:
                self._class(ctx)
            elif c == ABSTRACT and self.peek() == CLASS:
                self.uses_types()
                self.next()
                self._class(ctx)
            elif c == INTERFACE and self.ts and self.peek() in NAME_LIKE:
                self._interface(ctx)
            else:
                self.assign()
                self.semicolon()
            return True
        if c == "*":
            self.next()
            if self.eat(AS):
                self.next()
            self.take(FROM)
            self.take(STRING)
            self.import_end()
            return True
        if c == TYPE and self.peek() in "{*":
            self.uses_types()
            self.next()
            if self.k[self.i] == "*":
                self.next()
                if self.eat(AS):
                    self.next()
                self.take(FROM)
                self.take(STRING)
                self.import_end()
                return True
            c = "{"
        if c == "{":
            self.next()
            while self.k[self.i] != "}":
                if self.k[self.i] == TYPE and self.peek() not in ",}" and self.peek() != AS:
                    self.uses_types()
                    self.next()
                if self.k[self.i] not in WORDS and self.k[self.i] != STRING:
                    raise Broken
                self.next()
                if self.eat(AS):
                    if self.k[self.i] not in WORDS and self.k[self.i] != STRING:
                        raise Broken
                    self.next()
                if self.k[self.i] != "}":
                    self.take(",")
            self.next()
            if self.eat(FROM):
                self.take(STRING)
                self.import_end()
            else:
                self.semicolon()
            return True
        if c == "=":
            self.uses_types()
            self.next()
            self.expression()
            self.semicolon()
            return True
        if c == AS and self.ts and self.peek() == NAMESPACE:
            self.uses_types()
            self.next()
            self.next()
            self.name()
            self.semicolon()
            return True
        if c == IMPORT and self.ts:
            return self._import(ctx)
        if c in (VAR, CONST, FUNCTION, CLASS, "@", ENUM) or c in (LET, ASYNC, TYPE, INTERFACE, DECLARE, ABSTRACT, NAMESPACE, MODULE):
            if _STATEMENTS[c](self, ctx):
                return True
        raise Broken

    # -- declarations of TypeScript

    def _enum(self, ctx: int) -> bool:
        self.uses_types()
        self.take(ENUM)
        self.name()
        self.take("{")
        while self.k[self.i] != "}":
            self.property_name()
            if self.eat("="):
                self.assign()
            if self.k[self.i] != "}":
                self.take(",")
        self.next()
        return True

    def _type(self, ctx: int) -> bool:
        if not self.ts or self.peek() not in NAME_LIKE or self.k[self.i + 1] == NEWLINE:
            return False
        j = self.after(self.after(self.i))
        if self.k[j] not in "=<":
            return False
        self.uses_types()
        self.next()
        self.next()
        self.type_parameters()
        self.take("=")
        self.type()
        self.semicolon()
        return True

    def _interface(self, ctx: int) -> bool:
        if not self.ts or self.peek() not in NAME_LIKE or self.k[self.i + 1] == NEWLINE:
            return False
        self.uses_types()
        self.next()
        self.name()
        self.type_parameters()
        if self.eat(EXTENDS):
            self.type()
            while self.eat(","):
                self.type()
        if self.k[self.i] != "{":
            raise Broken
        self.object_type()
        return True

    def _declare(self, ctx: int) -> bool:
        if not self.ts or self.k[self.i + 1] == NEWLINE:
            return False
        p = self.peek()
        if p not in (VAR, LET, CONST, FUNCTION, CLASS, ENUM, TYPE, INTERFACE, NAMESPACE, MODULE, GLOBAL, ABSTRACT, ASYNC):
            return False
        self.uses_types()
        self.next()
        return bool(_STATEMENTS[self.k[self.i]](self, ctx | AMBIENT)) or self.fail()

    def fail(self):
        raise Broken

    def _abstract(self, ctx: int) -> bool:
        if not self.ts or self.peek() != CLASS:
            return False
        self.uses_types()
        self.next()
        return self._class(ctx)

    def _namespace(self, ctx: int) -> bool:
        c, p = self.k[self.i], self.peek()
        if not self.ts or self.k[self.i + 1] == NEWLINE:
            return False
        if not (p in NAME_LIKE and c != GLOBAL or p == STRING and c == MODULE or p == "{" and c == GLOBAL):
            return False
        self.uses_types()
        self.next()
        if c != GLOBAL:
            self.next()
            while self.eat("."):
                self.name()
        if self.k[self.i] == "{":
            self.take("{")
            self.statements(ctx & AMBIENT | AMBIENT if ctx & AMBIENT else AMBIENT, "}")
            self.next()
        else:
            self.semicolon()
        return True

    # -- types

    def type_parameters(self) -> None:
        if self.k[self.i] != "<":
            return
        self.uses_types()
        self.next()
        while True:
            while self.k[self.i] in (CONST, IN, OUT) and self.peek() in NAME_LIKE:
                self.next()
            self.name()
            if self.eat(EXTENDS):
                self.type()
            if self.eat("="):
                self.type()
            if self.eat(","):
                if self.k[self.i] in (">", GLUED):
                    break
                continue
            break
        self.close_angle()

    def close_angle(self) -> None:
        if self.k[self.i] != ">" and self.k[self.i] != GLUED:
            raise Broken
        self.next()

    def type_arguments(self) -> None:
        self.uses_types()
        self.take("<")
        self.type()
        while self.eat(","):
            self.type()
        self.close_angle()

    def type(self) -> None:
        c = self.k[self.i]
        if c == "<" or c == NEW or c == ABSTRACT and self.peek() == NEW:
            self.eat(ABSTRACT)
            self.eat(NEW)
            self.function_type()
        elif c == "(" and self.is_function_type():
            self.function_type()
        else:
            self.union_type()
            if self.k[self.i] == EXTENDS and not self.fresh() and not self.no_conditional:
                self.next()
                held, self.no_conditional = self.no_conditional, True
                try:
                    self.type()
                finally:
                    self.no_conditional = held
                self.take("?")
                self.type()
                self.take(":")
                self.type()

    no_conditional = False

    def is_function_type(self) -> bool:
        return self.k[self.after(self.match[self.i])] == ARROW

    def function_type(self) -> None:
        self.type_parameters()
        self.parameters()
        self.take(ARROW)
        held, self.no_conditional = self.no_conditional, False
        try:
            self.predicate()
        finally:
            self.no_conditional = held

    def union_type(self) -> None:
        if self.k[self.i] in "|&":
            self.next()
        while True:
            self.postfix_type()
            if self.k[self.i] in "|&":
                self.next()
                continue
            return

    def postfix_type(self) -> None:
        c = self.k[self.i]
        while c in (KEYOF, UNIQUE, READONLY, INFER) and self.peek() not in (",", ")", ">", GLUED, ";", "|", "&", "=", "]", "}", "[", EXTENDS, ":", "?", ".") and self.peek() != END:
            self.next()
            if c == INFER:
                self.name()
                if self.k[self.i] == EXTENDS and self.no_conditional:
                    to = self.mark()
                    self.next()
                    if self.attempt(lambda: self.union_type() or self.k[self.i] != "?" or self.fail()) is None:
                        self.back(to)
                return
            c = self.k[self.i]
        if c == "(" and self.is_function_type() or c == NEW or c == "<":
            self.eat(NEW)
            self.function_type()
        else:
            self.simple_type()
        while not self.fresh():
            if self.k[self.i] == "[":
                self.next()
                if not self.eat("]"):
                    self.type()
                    self.take("]")
            else:
                return

    def simple_type(self) -> None:
        c = self.k[self.i]
        if c == "(":
            self.next()
            held, self.no_conditional = self.no_conditional, False
            self.type()
            self.no_conditional = held
            self.take(")")
        elif c == "[":
            self.next()
            held, self.no_conditional = self.no_conditional, False
            while self.k[self.i] != "]":
                self.eat(SPREAD)
                j = self.after(self.i)
                if self.k[self.i] in WORDS and (self.k[j] == ":" or self.k[j] == "?" and self.k[self.after(j)] == ":"):
                    self.next()
                    self.eat("?")
                    self.take(":")
                self.type()
                self.eat("?")
                if self.k[self.i] != "]":
                    self.take(",")
            self.no_conditional = held
            self.next()
        elif c == "{":
            held, self.no_conditional = self.no_conditional, False
            if not self.mapped_type():
                self.object_type()
            self.no_conditional = held
        elif c == TEMPLATE:
            self.next()
        elif c == "-":
            self.next()
            self.take(NUMBER)
        elif c in LITERAL and c != REGEX or c == VOID:
            self.next()
        elif c == TYPEOF:
            self.next()
            if self.k[self.i] == IMPORT:
                return self.simple_type()
            if self.k[self.i] != THIS:
                self.name()
            else:
                self.next()
            while self.k[self.i] == ".":
                self.next()
                if self.k[self.i] not in WORDS and self.k[self.i] != PRIVATE:
                    raise Broken
                self.next()
            if self.k[self.i] == "<" and not self.fresh():
                self.type_arguments()
        elif c == IMPORT:
            self.next()
            self.take("(")
            self.type()
            if self.eat(","):
                self.assign()
            self.take(")")
            while self.eat("."):
                self.next()
            if self.k[self.i] == "<":
                self.type_arguments()
        elif c in NAME_LIKE or c == THIS:
            self.next()
            while self.k[self.i] == ".":
                self.next()
                if self.k[self.i] not in WORDS:
                    raise Broken
                self.next()
            if self.k[self.i] == "<" and not self.fresh():
                self.type_arguments()
        else:
            raise Broken

    def mapped_type(self) -> bool:
        j = self.after(self.i)
        if self.k[j] in "+-":
            j = self.after(j)
        if self.k[j] == READONLY:
            j = self.after(j)
        if self.k[j] != "[" or self.k[self.after(j)] not in NAME_LIKE or self.k[self.after(self.after(j))] != IN:
            return False
        self.i = self.after(self.after(self.after(j)))
        self.type()
        if self.eat(AS):
            self.type()
        self.take("]")
        if self.k[self.i] in "+-":
            self.next()
        self.eat("?")
        if self.eat(":"):
            self.type()
        self.eat(";") or self.eat(",")
        self.take("}")
        return True

    def object_type(self) -> None:
        self.take("{")
        while self.k[self.i] != "}":
            c = self.k[self.i]
            while c in (READONLY, GET, SET) and self.peek() not in "(:?;,}<" and self.k[self.i + 1] != NEWLINE:
                self.next()
                c = self.k[self.i]
            if c == "(" or c == "<" or c == NEW and self.peek() in "(<":
                self.eat(NEW)
                self.type_parameters()
                self.parameters()
                self.result_type()
            elif c == "[" and self.index_signature():
                pass
            else:
                self.property_name()
                self.eat("?")
                if self.k[self.i] in "(<":
                    self.type_parameters()
                    self.parameters()
                    self.result_type()
                else:
                    self.annotation()
            if self.k[self.i] in ";,":
                self.next()
            elif self.k[self.i] != "}" and not self.fresh():
                raise Broken
        self.next()

    # -- expressions; each gives (what it is, text of a member chain)

    def expression(self) -> None:
        self.assign()
        while self.k[self.i] == ",":
            self.next()
            self.assign()

    def assign(self, with_in: bool = True, head: bool = False):
        c = self.k[self.i]
        if c in NAME_LIKE:
            p = self.peek()
            if p == ARROW and self.k[self.i + 1] != NEWLINE:
                self.next()
                return self.arrow_body(with_in)
            if c == ASYNC and self.k[self.i + 1] != NEWLINE:
                if p in NAME_LIKE and self.k[self.after(self.after(self.i))] == ARROW:
                    self.next()
                    self.next()
                    return self.arrow_body(with_in)
                if p == "(" or p == "<" and self.ts:
                    to = self.mark()
                    self.next()
                    found = self.arrow(with_in)
                    if found:
                        return found
                    self.back(to)
            if c == YIELD and (p not in ASSIGN and p not in ".)];,:?=}" or p in (NAME,)):
                self.next()
                if not self.fresh() and self.k[self.i] not in (")", "]", "}", ",", ";", ":", END):
                    self.eat("*")
                    self.assign(with_in)
                return OTHER
        elif c == "(" or c == "<" and self.ts:
            found = self.arrow(with_in)
            if found:
                return found
        kind, text = self.conditional(with_in)
        c = self.k[self.i]
        if c in ASSIGN or _SHIFT_ASSIGN.match(self.k, self.i):
            pass
        else:
            if kind == "cover" and not (head and c in (OF, IN)):
                raise Broken
            return kind, text
        if c == "=" and kind in ("obj", "arr", "cover"):
            self.next()
        elif kind in ("id", "mem", "target"):
            if c == GLUED:
                return self.shift_assign(with_in)
            self.next()
        else:
            raise Broken
        self.assign(with_in)
        return OTHER

    def shift_assign(self, with_in: bool):
        while self.k[self.i] == GLUED:
            self.i += 1
        self.take("=") if self.k[self.i] == "=" else self.fail()
        self.assign(with_in)
        return OTHER

    def arrow(self, with_in: bool):
        """An arrow function from its type parameters or '(', or None and nothing taken."""
        i = self.i
        if self.k[i] == "(":
            past = self.after(self.match[i])
            p = self.k[past]
            if p == ARROW:
                if self.k[past - 1] == NEWLINE:
                    return None
            elif p != ":" or not self.ts:
                return None
        elif self.k[i] == "<" and not self.ts:
            return None
        return self.attempt(Parser._arrow, self, with_in)

    def _arrow(self, with_in: bool):
        self.type_parameters()
        self.parameters()
        self.result_type()
        if self.k[self.i] != ARROW or self.fresh():
            raise Broken
        return self.arrow_body(with_in)

    def arrow_body(self, with_in: bool):
        self.take(ARROW)
        first = len(self.calls)
        if self.k[self.i] == "{":
            self.block(IN_FUNCTION)
        else:
            self.assign(with_in)
        return "fn", (first, len(self.calls))

    def conditional(self, with_in: bool):
        found = self.binary(0, with_in)
        if self.k[self.i] != "?":
            return found
        self.next()
        to = self.mark()
        try:
            self.assign()
            self.take(":")
        except Broken:
            if not self.ts:
                raise
            # 'a ? (b) : c => d': what looked like an arrow with a result type isn't one
            self.back(to)
            self.no_typed_arrow = True
            try:
                self.conditional(True)
                self.take(":")
            finally:
                self.no_typed_arrow = False
        self.assign(with_in)
        return OTHER

    no_typed_arrow = False

    def binary(self, least: int, with_in: bool):
        found = self.unary()
        while True:
            c = self.k[self.i]
            p = BINARY.get(c)
            if p is None:
                if c == AS or c == SATISFIES:
                    if self.fresh() or not self.ts or least >= 8:
                        return found
                    self.uses_types()
                    self.next()
                    if self.k[self.i] == CONST:
                        self.next()
                    else:
                        self.type()
                    found = ("target" if found[0] in ("id", "mem") else "other", None)
                    continue
                return found
            if p <= least and not (p == 12 and least == 12):
                return found
            if c == IN and not with_in:
                return found
            if c == GLUED:  # '>>', '>>>' or '>=', or the start of '>>='
                n, j = 0, self.i
                while self.k[j] == GLUED:
                    j += 1
                if self.k[j] == "=":
                    if j - self.i > 1:
                        return found
                    p = 8
                elif self.k[j] == ">":
                    n = j - self.i
                    p = 9
                    if n > 2:
                        raise Broken
                else:
                    raise Broken
                if p <= least:
                    return found
                self.i = j
            if found[0] == "fn" or found[0] == "cover":
                raise Broken
            self.next()
            self.binary(p if p != 12 else 11, with_in)
            found = OTHER

    def unary(self):
        c = self.k[self.i]
        if c in UNARY:
            self.next()
            self.unary()
            return OTHER
        if c in UPDATE:
            self.next()
            if self.unary()[0] not in ("id", "mem", "target"):
                raise Broken
            return OTHER
        if c == AWAIT:
            p = self.peek()
            if p not in ".)];,:?}" and p not in ASSIGN and p != ARROW and p != END and not (p in BINARY and p not in "+-/<"):
                self.next()
                self.unary()
                return OTHER
        if c == "<" and self.ts:  # a type assertion
            self.uses_types()
            self.next()
            if not self.eat(CONST):
                self.type()
            self.close_angle()
            self.unary()
            return OTHER
        found = self.left_side()
        if self.k[self.i] in UPDATE and not self.fresh():
            if found[0] not in ("id", "mem", "target"):
                raise Broken
            self.next()
            return OTHER
        return found

    def left_side(self):
        c = self.k[self.i]
        if c == NEW:
            found = self.new()
        elif c == IMPORT:
            self.next()
            if self.eat("."):
                self.name()
            elif self.k[self.i] == "(":
                self.arguments()
            else:
                raise Broken
            found = ("call", None)
        elif c == SUPER:
            self.next()
            if self.k[self.i] not in "(.[":
                raise Broken
            found = OTHER
        else:
            found = self.primary()
            if found[0] == "fn" and self.k[self.i - 1 if self.k[self.i - 1] != NEWLINE else self.i - 2] != "}":
                return found
        return self.suffixes(found, True)

    def suffixes(self, found, calls: bool):
        optional = False
        while True:
            c = self.k[self.i]
            if c == ".":
                self.next()
                found = self.property(found)
                if optional:
                    found = ("opt", found[1])
            elif c == OPT:
                if not calls:
                    raise Broken
                self.next()
                optional = True
                c = self.k[self.i]
                if c == "(":
                    self.arguments()
                    self.called(found)
                    found = ("call", None)
                elif c == "[":
                    self.next()
                    self.expression()
                    self.take("]")
                    found = ("opt", None)
                elif c == "<" and self.ts:
                    self.type_arguments()
                    self.arguments()
                    self.called(found)
                    found = ("call", None)
                else:
                    found = ("opt", self.property(found)[1])
            elif c == "[":
                self.next()
                self.expression()
                self.take("]")
                found = ("opt" if optional else "mem", None)
            elif c == "(" and calls:
                self.arguments()
                self.called(found)
                found = ("call", None)
            elif c == TEMPLATE:
                if optional:
                    raise Broken
                self.template()
                if calls:
                    self.called(found)
                    found = ("call", None)
                else:
                    found = OTHER
            elif c == "!" and self.ts and not self.fresh():
                p = self.k[self.i + 1]
                if p in (NAME, NUMBER, STRING):
                    return found
                self.uses_types()
                self.next()
                found = ("mem" if found[0] in ("id", "mem", "opt") else "other", None)
            elif c == "<" and self.ts:
                if not self.attempt(Parser.call_types, self):
                    return found
                if self.k[self.i] not in ("(", TEMPLATE):
                    found = OTHER
            else:
                return found

    def call_types(self) -> bool:
        self.type_arguments()
        c = self.k[self.i]
        if c in ("(", TEMPLATE):
            return True
        if c in "<>+-" or c == GLUED:
            raise Broken
        if self.fresh() or c in BINARY or c in ASSIGN or c in ")],;:?}.!" or c in (END, OPT, ARROW, AS, SATISFIES):
            return True
        raise Broken

    def property(self, found):
        c = self.k[self.i]
        if c not in WORDS and c != PRIVATE:
            raise Broken
        text = self.v[self.i]
        self.next()
        kind, chain = found
        if kind == "call":
            return "mem", text
        return "mem", f"{chain}.{text}" if isinstance(chain, str) else None

    def called(self, found) -> None:
        if isinstance(found[1], str):
            self.calls.append(found[1])

    def new(self):
        self.next()
        if self.eat("."):
            self.name()
            return OTHER
        if self.k[self.i] == NEW:
            found = self.new()
        elif self.k[self.i] == IMPORT:
            raise Broken
        else:
            found = self.primary()
        found = self.suffixes(found, False)
        if self.k[self.i] == "(":
            self.arguments()
        self.called(found)
        return OTHER

    def arguments(self) -> None:
        self.take("(")
        while self.k[self.i] != ")":
            self.eat(SPREAD)
            self.assign()
            if self.k[self.i] != ")":
                self.take(",")
        self.next()

    def template(self) -> None:
        if self.collect:
            self.embedded(self.i)
        self.next()

    def embedded(self, at: int) -> None:
        for part in self.inner.get(at, ()):
            sub = Parser(part, self.ts, True)
            sub.calls = self.calls
            sub.embedded_expression()

    def embedded_expression(self) -> None:
        """What stands between the braces of a template or a JSX element."""
        if self.k[self.i] == CHILD:  # a child of a JSX element: nothing, spread or expression
            self.next()
            if self.k[self.i] == END:
                return
            self.eat(SPREAD)
        elif self.k[self.i] == SPREAD_IN:
            self.next()
            self.take(SPREAD)
        self.expression()
        if self.k[self.i] != END:
            raise Broken

    def primary(self):
        i = self.i
        c = self.k[i]
        if c in NAME_LIKE:
            if c == ASYNC and self.peek() == FUNCTION and self.k[i + 1] != NEWLINE:
                self.next()
                return self.function_expression()
            self.next()
            return "id", self.v[i] if c != _K["undefined"] else None
        if c in LITERAL or c == THIS:
            self.next()
            return OTHER
        if c == TEMPLATE:
            self.template()
            return OTHER
        if c == JSX:
            if self.collect:
                self.embedded(i)
            self.next()
            return OTHER
        if c == "(":
            self.next()
            kind, _ = self.assign()
            while self.eat(","):
                kind = "other"
                self.assign()
            self.take(")")
            return ("target" if kind in ("id", "mem", "target") else "other"), None
        if c == "[":
            self.next()
            kind = "arr"
            while self.k[self.i] != "]":
                if self.eat(","):
                    continue
                self.eat(SPREAD)
                if self.assign(True, False if self.k[self.i] not in "{[" else False)[0] == "cover":
                    kind = "cover"
                if self.k[self.i] != "]":
                    self.take(",")
            self.next()
            return kind, None
        if c == "{":
            return self.object()
        if c == FUNCTION:
            return self.function_expression()
        if c == CLASS or c == "@":
            self.decorators()
            self._class(0)
            return OTHER
        if c == PRIVATE:
            if self.peek() != IN:
                raise Broken
            self.next()
            return OTHER
        raise Broken

    def function_expression(self):
        self.take(FUNCTION)
        self.eat("*")
        if self.k[self.i] in NAME_LIKE:
            self.next()
        first, last, _ = self.function_rest()
        return "fn", (first, last)

    def object(self):
        self.take("{")
        kind = "obj"
        while self.k[self.i] != "}":
            if self.eat(SPREAD):
                self.assign()
            else:
                began = len(self.calls)
                accessor = False
                while self.k[self.i] in (ASYNC, GET, SET) and self.peek() not in ",:(}=<" and not (self.k[self.i] == ASYNC and self.k[self.i + 1] == NEWLINE):
                    self.next()
                    accessor = True
                accessor |= self.eat("*")
                at = self.i
                short = self.k[at] in NAME_LIKE
                self.property_name()
                if self.k[self.i] in "(<":
                    self.type_parameters()
                    self.parameters()
                    self.result_type()
                    self.block(IN_FUNCTION)
                    del self.calls[began:]
                elif accessor:
                    raise Broken
                elif self.eat(":"):
                    if self.k[self.i] in "{[":
                        found = self.cover_value()
                        if found == "cover":
                            kind = "cover"
                    else:
                        self.assign()
                elif short:
                    if self.eat("="):
                        self.assign()
                        kind = "cover"
                else:
                    raise Broken
            if self.k[self.i] != "}":
                self.take(",")
        self.next()
        return kind, None

    def cover_value(self) -> str:
        """A nested pattern may hold initialisers that only an assignment around it makes legal."""
        found = self.conditional(True)[0]
        if self.k[self.i] == "=" and found in ("obj", "arr", "cover", "id", "mem", "target"):
            self.next()
            self.assign()
            return "obj"
        if self.k[self.i] in ASSIGN and found in ("id", "mem", "target"):
            self.next()
            self.assign()
            return "other"
        return found


_STATEMENTS = {
    ";": Parser._empty, "{": Parser._block, VAR: Parser._var, LET: Parser._var, CONST: Parser._var, USING: Parser._var, FUNCTION: Parser._function, ASYNC: Parser._function,
    CLASS: Parser._class, "@": Parser._decorated, IF: Parser._if, FOR: Parser._for, WHILE: Parser._while, WITH: Parser._with, DO: Parser._do, RETURN: Parser._return,
    BREAK: Parser._jump, CONTINUE: Parser._jump, THROW: Parser._throw, TRY: Parser._try, SWITCH: Parser._switch, DEBUGGER: Parser._debugger, IMPORT: Parser._import, EXPORT: Parser._export,
    ENUM: Parser._enum, TYPE: Parser._type, INTERFACE: Parser._interface, DECLARE: Parser._declare, ABSTRACT: Parser._abstract, NAMESPACE: Parser._namespace, MODULE: Parser._namespace, GLOBAL: Parser._namespace,
}


def _all_parts(tokens: Tokens):
    waiting = [tokens]
    while waiting:
        for parts in waiting.pop().inner.values():
            yield from parts
            waiting += parts


def _roomy(f):
    """f, and again without a limit of depth where the ordinary one is too small.

    The rules call each other as plain functions, which take memory but no
    stack of C: ``attempt`` gets functions, not bound methods, for that reason.
    """

    @wraps(f)
    def run(*args):
        try:
            return f(*args)
        except RecursionError:
            pass
        held = sys.getrecursionlimit()
        sys.setrecursionlimit(2**31 - 1)
        try:
            return f(*args)
        finally:
            sys.setrecursionlimit(held)

    return run


def _parses(tokens: Tokens, ts: bool) -> tuple[bool, bool]:
    """Whether the tokens are a program, and whether type syntax was needed."""
    if tokens.bad:
        return False, False
    typed = False
    try:
        p = Parser(tokens, ts)
        p.program()
        typed = p.typed
        for part in _all_parts(tokens):
            key = (ts, -1, part.kinds)
            found = _seen.get(key)
            if found is None:
                q = Parser(part, ts)
                q.embedded_expression()
                found = int(q.typed)
                if len(part.kinds) <= LONGEST:
                    if len(_seen) >= MEMORY:
                        _seen.clear()
                    _seen[key] = found
            typed |= bool(found)
    except Broken:
        return False, False
    return True, typed


@_roomy
def valid(src: str, grammar: str) -> bool:
    ts, jsx = GRAMMARS[grammar]
    return _parses(tokenise(src, jsx), ts)[0]


def grammar_of(file: str) -> str | None:
    """The grammar of a file by its extension, None for other files."""
    dot = file.rfind(".")
    return _OF_EXTENSION.get(file[dot:].lower()) if dot >= 0 else None


_TYPES = "".join(_K[w] for w in "any bigint boolean never number object string symbol undefined unknown void".split())
_HINT = re.compile(f"[a)\\]?]:[{_TYPES}]|[{INTERFACE}{ENUM}{NAMESPACE}{DECLARE}{IMPLEMENTS}{TYPE}{SATISFIES}][a{{]|{AS}[{_TYPES}{CONST}]")


def ranked(tokens: Tokens) -> list[str]:
    """The grammars, the likeliest by the kinds of the tokens first."""
    typed = bool(_HINT.search(tokens.kinds))
    return sorted(GRAMMARS, key=lambda g: ((GRAMMARS[g][0] != typed) + (GRAMMARS[g][1] != tokens.jsx), g))


@_roomy
def syntax_of(src: str, own: str) -> tuple[bool, list[str]]:
    """Whether the text is valid in its own grammar, and all grammars in which it is.

    Every grammar is tried, the likeliest by its tokens first. A parse that met
    no type syntax holds without types too, and tokens that hold no JSX are the
    same in both forms, so such a parse settles the others.
    """
    with_jsx = tokenise(src, True)
    cut = {True: with_jsx, False: tokenise(src, False) if with_jsx.jsx or with_jsx.bad else with_jsx}
    done: dict[str, bool] = {}
    for g in ranked(with_jsx):
        if g in done:
            continue
        ts, jsx = GRAMMARS[g]
        done[g], typed = _parses(cut[jsx], ts)
        for h, (h_ts, h_jsx) in GRAMMARS.items():
            if cut[h_jsx] is cut[jsx] and (h_ts == ts or ts and done[g] and not typed):
                done.setdefault(h, done[g])
    return done[own], [g for g in GRAMMARS if done[g]]


@_roomy
def extract(src: str, grammar: str) -> dict:
    """Top-level functions with their calls, imports, and whether the text had errors.

    A text with errors keeps the statements that have none: those before the
    first error, and those from the next line on that is outside brackets.
    """
    ts, jsx = GRAMMARS[grammar]
    tokens = tokenise(src, jsx, places=True)
    p = Parser(tokens, ts, True)
    errors = not p.sound_statements() or tokens.bad
    functions, imports = p.functions, p.imports
    ends = [m.start() for m in re.finditer("\n", src)]
    starts = tokens.starts

    def row(at: int) -> int:
        return bisect_left(ends, starts[at]) + 1

    kept, seen, twice = [], set(), []
    for name, first, last, calls in functions:
        if name in seen:
            twice.append(name)
            continue
        seen.add(name)
        # a multi-line last token, as a template, ends further down
        end = row(last) + (tokens.values[last].count("\n") if tokens.kinds[last] == STRING else 0)
        kept.append({"name": name, "start_line": row(first), "end_line": end, "calls": calls})
    return {
        "functions": kept,
        "imports": [dict(zip(("local_name", "imported_name", "module_specifier", "is_default", "is_namespace"), x)) for x in imports],
        "had_parse_errors": errors,
        "duplicate_function_names": twice,
    }
