"""Recursive-descent parser: request text to tree."""

from __future__ import annotations

from .errors import SemanticFault, SyntaxFault
from .lexer import Token, tokens
from .tree import LINKAGES, ROW_FIELDS, SET_FIELDS, Constraint, Pattern, Predicate, Request

VERBS = ("read", "write", "iterate", "islink", "dump", "restore", "verify", "status", "set", "sync")
MODIFIERS = ("asof", "cost", "dateline", "id", "heatmap", "loglevel", "timeout")
_COMPARE = ("=", "!=", "~=", "<", "<=", ">", ">=")
_TEXT = {"name": ("=", "!=", "~="), "value": _COMPARE, "type": ("=", "!=")}
_IDS = ("guid", "next", "prev", "previous", *LINKAGES)
_ALIASES = {"prev": "previous"}
_ONCE = "given twice"


class Parser:
    def __init__(self, text: str):
        self.list, self.at = tokens(text), 0

    @property
    def token(self) -> Token:
        return self.list[self.at]

    def take(self, kind: str | None = None, *texts: str) -> Token:
        t = self.token
        if kind and t.kind != kind or texts and t.text.lower() not in texts:
            raise SyntaxFault(f"{t.text!r} at {t.at}: expected {' or '.join(texts) or kind}")
        self.at += 1
        return t

    def sees(self, *texts: str, kind: str = "mark", ahead: int = 0) -> bool:
        t = self.list[min(self.at + ahead, len(self.list) - 1)]
        return t.kind == kind and t.text.lower() in texts

    # --- requests

    def request(self) -> Request:
        verb = self.take("atom", *VERBS).text.lower()
        request = Request(verb)
        while self.token.kind == "atom" and self.token.text.lower() in MODIFIERS:
            name = self.take().text.lower()
            self.take("mark", *(("=", "~=") if name == "cost" else ("=",)))
            request.modifiers[name] = self.word()
        if verb in ("read", "write", "iterate", "islink"):
            request.root = self.constraint()
        elif self.sees("("):
            request.arguments = self.arguments()
        if self.token.kind != "end":
            raise SyntaxFault(f"{self.token.text!r} at {self.token.at}: expected the end")
        return request

    def arguments(self) -> list:
        self.take("mark", "(")
        out: list = []
        while not self.sees(")"):
            if self.sees("("):
                out.append(self.arguments())
            elif self.token.kind == "atom" and self.sees("=", ahead=1):
                name = self.take().text.lower()
                self.take()
                out.append((name, self.word()))
            else:
                t = self.take()
                out.append(None if t.kind == "atom" and t.text.lower() == "null" else t.text)
        self.take("mark", ")")
        return out

    def word(self) -> str:
        if self.token.kind not in ("atom", "string"):
            raise SyntaxFault(f"{self.token.text!r} at {self.token.at}: expected a name or a string")
        return self.take().text

    def number(self) -> int:
        text = self.take("atom").text
        if not text.isdigit():
            raise SyntaxFault(f"{text!r}: expected a number")
        return int(text)

    # --- constraints

    def constraint(self) -> Constraint:
        self.take("mark", "(")
        out = Constraint()
        self.body(out, ")")
        self.take("mark", ")")
        return out

    def body(self, out: Constraint, close: str) -> None:
        while not self.sees(close):
            if self.token.kind == "end":
                raise SyntaxFault(f"the request ends before {close!r}")
            if self.sees("|", "||"):
                self.take()
                tail = Constraint()
                self.one(tail)
                self.choice(out, Constraint(), tail)
                continue
            part = Constraint()
            self.one(part)
            if self.sees("|", "||"):
                self.choice(out, part, None)
            else:
                merge(out, part)

    def choice(self, out: Constraint, head: Constraint, tail: Constraint | None) -> None:
        """``a | b | c`` is a | (b | c); either side may be empty."""
        if tail is None:
            self.take("mark", "|", "||")
            tail = Constraint()
            if not (self.sees(")", "}") or self.token.kind == "end"):
                self.one(tail)
        if self.sees("|", "||"):
            rest = Constraint()
            self.choice(rest, tail, None)
            tail = rest
        out.choices.append((head, tail))

    def one(self, out: Constraint) -> None:
        t = self.token
        if t.kind == "mark" and t.text == "(":
            child = self.constraint()
            out.children.append(child)
        elif t.kind == "mark" and t.text == "{":
            self.take()
            self.body(out, "}")
            self.take("mark", "}")
        elif t.kind == "mark" and t.text in ("<-", "->"):
            self.take()
            if t.text == "<-" and self.token.kind == "atom" and self.token.text.lower() in LINKAGES and not self.sees(*_COMPARE, "->", ahead=1):
                merge(out, Constraint(linkage=("from", self.take().text.lower())))
            else:
                merge(out, Constraint(arrow=t.text))
        elif t.kind == "string":
            out.predicates.append(Predicate("type", "=", [self.take().text]))
        elif t.kind == "var":
            name = self.take().text
            self.take("mark", "=")
            out.variables.append((name, self.pattern()))
        elif t.kind == "atom":
            self.keyword(out, self.take().text.lower())
        else:
            raise SyntaxFault(f"{t.text!r} at {t.at} is out of place")

    def keyword(self, out: Constraint, word: str) -> None:
        if word in ("any", "node"):
            return
        if word in LINKAGES and self.sees("->"):
            self.take()
            child = self.constraint()
            if child.linkage or child.arrow:
                raise SemanticFault("a constraint has two linkages")
            child.linkage = ("to", word)
            out.children.append(child)
        elif word in _TEXT:
            out.predicates.append(Predicate(word, self.operator(*_TEXT[word]), self.values()))
        elif word in _IDS:
            out.predicates.append(Predicate(_ALIASES.get(word, word), self.operator("=", "!=", "~="), self.values()))
        elif word == "timestamp":
            out.predicates.append(Predicate(word, self.operator("<", "<=", "=", "!=", ">=", ">"), [self.word()]))
        elif word == "dateline":
            out.predicates.append(Predicate(word, self.operator("<", ">"), [self.word()]))
        elif word in ("newest", "oldest"):
            getattr(out, word).append((self.operator("<", "<=", "=", ">=", ">"), self.number()))
        elif word in ("live", "archival"):
            self.take("mark", "=")
            out.flags[word] = self.take("atom", "true", "false", "dontcare").text.lower()
        elif word in ("valuetype", "datatype"):
            self.take("mark", "=")
            out.predicates.append(Predicate("valuetype", "=", [self.word()]))
        elif word == "count":
            out.count.append((self.operator("<", "<=", "=", ">=", ">"), self.number()))
        elif word == "atleast":
            self.take("mark", "=")
            out.count.append((">=", self.number()))
        elif word == "optional":
            out.optional = True
        elif word == "false":
            out.false = True
        elif word in ("pagesize", "resultpagesize", "countlimit", "start"):
            self.take("mark", "=")
            merge(out, Constraint(pages={word: self.number()}))
        elif word == "cursor":
            self.take("mark", "=")
            merge(out, Constraint(cursor=self.word()))
        elif word == "sort":
            self.take("mark", "=")
            p = self.pattern()
            merge(out, Constraint(sort=p.items if p.kind == "list" else [p]))
        elif word in ("comparator", "value-comparator", "sort-comparator"):
            self.take("mark", "=")
            merge(out, Constraint(comparators={word: [v or "" for v in self.values()]}))
        elif word == "result":
            self.take("mark", "=")
            merge(out, Constraint(result=self.pattern()))
        elif word in ("key", "unique"):
            self.take("mark", "=")
            names = [v or "" for v in self.values()]
            merge(out, Constraint(**{word: names}))
        elif word == "anchor":
            how = "true"
            if self.sees("="):
                self.take()
                how = self.take("atom", "true", "false", "local").text.lower()
            merge(out, Constraint(anchor=how))
        else:
            raise SyntaxFault(f"{word!r} is no constraint")

    def operator(self, *allowed: str) -> str:
        op = self.take("mark").text
        if op not in allowed:
            raise SyntaxFault(f"operator {op!r} can't be used here")
        return op

    def values(self) -> list[str | None]:
        """A value or a list of values; null is None, as is an empty list's single meaning."""
        if not self.sees("("):
            t = self.token
            text = self.word()
            return [None if t.kind == "atom" and text.lower() == "null" else text]
        self.take()
        out: list[str | None] = []
        while not self.sees(")"):
            t = self.token
            text = self.word()
            out.append(None if t.kind == "atom" and text.lower() == "null" else text)
        self.take()
        return out or [None]

    def pattern(self, depth: int = 0) -> Pattern:
        sign = self.take().text if self.sees("+", "-") else "+"
        t = self.take()
        if t.kind == "mark" and t.text == "(":
            items = []
            while not self.sees(")"):
                items.append(self.pattern(depth + 1))
            self.take()
            p = Pattern("list", items=items)
            if p.depth() > 2:
                raise SyntaxFault("results nest two deep at most")
        elif t.kind == "var":
            p = Pattern("var", t.text)
        elif t.kind == "atom" and t.text.lower() == "literal":
            self.take("mark", "=")
            p = Pattern("literal", self.word())
        elif t.kind == "atom":
            name = _ALIASES.get(t.text.lower(), t.text.lower())
            if name not in ROW_FIELDS + SET_FIELDS:
                raise SyntaxFault(f"{t.text!r} is no result")
            if name in SET_FIELDS and depth > 1:
                raise SyntaxFault(f"{name!r} describes the whole set and stands outside of a match's list")
            p = Pattern("field", name)
        else:
            raise SyntaxFault(f"{t.text!r} at {t.at}: expected a result")
        p.descending = sign == "-"
        return p


def merge(into: Constraint, part: Constraint) -> None:
    """Put ``part`` into ``into``; what may be given once only is an error the second time."""
    for name in ("linkage", "arrow", "cursor", "sort", "result", "key", "unique", "anchor"):
        value = getattr(part, name)
        if value is not None:
            if getattr(into, name) is not None:
                raise SemanticFault(f"{name} {_ONCE}")
            setattr(into, name, value)
    for name in ("flags", "pages", "comparators"):
        own, more = getattr(into, name), getattr(part, name)
        if twice := own.keys() & more.keys():
            if name != "flags" or any(own[k] != more[k] for k in twice):
                raise SemanticFault(f"{', '.join(twice)} {_ONCE}")
        own.update(more)
    for name in ("predicates", "newest", "oldest", "count", "variables", "children", "choices"):
        getattr(into, name).extend(getattr(part, name))
    into.optional |= part.optional
    into.false |= part.false


def parse(text: str) -> Request:
    return Parser(text).request()
