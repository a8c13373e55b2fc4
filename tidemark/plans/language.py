"""The query language: text to a typed plan.

    FIND|SELECT [target {, target}] [FROM entity] { WHERE c {AND c} | BETWEEN t AND t | ORDER BY f [ASC|DESC] | LIMIT n }
    ANALYZE metric [FROM entity] { WHERE ... | BETWEEN ... } [GROUP BY minute|hour|day]
    DIFF [entity] FROM t TO t
    STATE [entity] AS OF t

Keywords are case-insensitive, names are not. A condition is `field op literal`; a bare name
on the right is text. Whatever is left over is an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.timestamps import parse_literal

KEYWORDS = frozenset("FIND SELECT ANALYZE DIFF STATE FROM WHERE AND BETWEEN ORDER GROUP BY LIMIT ASC DESC AS OF TO".split())
_SCANNER = re.compile(
    r"""(?P<space>\s+)
      | (?P<number>-?[0-9][0-9.]*)
      | (?P<name>[A-Za-z_-][\w.-]*|\*)
      | (?P<string>'[^']*'|"[^"]*")
      | (?P<op>==|!=|>=|<=|=|>|<)
      | (?P<comma>,)""",
    re.X,
)


class QueryError(ValueError):
    """A query that cannot be read; `line` and `column` count from one."""

    def __init__(self, message: str, line: int = 0, column: int = 0):
        super().__init__(f"{message} at line {line}, column {column}" if line else message)
        self.line, self.column = line, column


@dataclass(frozen=True)
class Token:
    kind: str
    value: str | int | float
    line: int
    column: int


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    literal: str | int | float


@dataclass
class Plan:
    """What a query asks for; `targets` empty means every type."""

    command: str
    targets: tuple[str, ...] = ()
    entity: str | None = None
    conditions: list[Condition] = field(default_factory=list)
    start: int | None = None
    end: int | None = None
    order_by: str = "timestamp"
    descending: bool = False
    limit: int | None = None
    group_by: str | None = None
    at: int | None = None


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        line, column = text.count("\n", 0, at) + 1, at - (text.rfind("\n", 0, at) + 1) + 1
        m = _SCANNER.match(text, at)
        if m is None:
            raise QueryError("string without an end" if text[at] in "'\"" else f"unexpected {text[at]!r}", line, column)
        at = m.end()
        kind, value = m.lastgroup, m.group()
        if kind == "space":
            continue
        if kind == "number":
            try:
                value = float(value) if "." in value else int(value)
            except ValueError:
                raise QueryError(f"not a number: {value}", line, column) from None
        elif kind == "string":
            value = value[1:-1]
        elif kind == "op":
            value = "=" if value == "==" else value
        elif kind == "name" and value.upper() in KEYWORDS:
            kind, value = "keyword", value.upper()
        out.append(Token(kind, value, line, column))
    return out


class _Reader:
    def __init__(self, text: str):
        self.tokens, self.at = tokenize(text), 0

    def peek(self, *wanted: str) -> bool:
        """Whether the next token is one of the kinds, or one of the keywords (upper case)."""
        if self.at >= len(self.tokens):
            return False
        t = self.tokens[self.at]
        return t.kind in wanted or (t.kind == "keyword" and t.value in wanted)

    def accept(self, *wanted: str) -> Token | None:
        if self.peek(*wanted):
            self.at += 1
            return self.tokens[self.at - 1]
        return None

    def expect(self, *wanted: str) -> Token:
        got = self.accept(*wanted)
        if got is None:
            self.fail("expected " + " or ".join(wanted))
        return got

    def fail(self, message: str):
        if self.at < len(self.tokens):
            t = self.tokens[self.at]
            raise QueryError(f"{message}, found {t.value!r}", t.line, t.column)
        raise QueryError(f"{message}, found the end")

    def timestamp(self) -> int:
        t = self.expect("number", "string", "name")
        try:
            return parse_literal(t.value)
        except ValueError as err:
            raise QueryError(str(err), t.line, t.column) from None


def parse(text: str) -> Plan:
    r = _Reader(text)
    word = r.expect("FIND", "SELECT", "ANALYZE", "DIFF", "STATE").value
    plan = Plan("FIND" if word == "SELECT" else word)
    {"FIND": _find, "ANALYZE": _analyze, "DIFF": _diff, "STATE": _state}[plan.command](r, plan)
    if r.at < len(r.tokens):
        r.fail("expected the end")
    return plan


def _targets(r: _Reader, plan: Plan) -> None:
    if first := r.accept("name", "string"):
        names = [first.value]
        while r.accept("comma"):
            names.append(r.expect("name", "string").value)
        plan.targets = () if set(names) & {"*", "events"} else tuple(dict.fromkeys(n.lower() for n in names))
    if r.accept("FROM"):
        plan.entity = r.expect("name", "string").value


def _where(r: _Reader, plan: Plan) -> None:
    while True:
        name, op = r.expect("name").value, r.expect("op").value
        literal = r.expect("string", "number", "name").value
        if name == "entity" and op == "=" and isinstance(literal, str):
            plan.entity = literal
        elif name == "type" and op == "=" and isinstance(literal, str) and not plan.targets:
            plan.targets = (literal.lower(),)
        else:
            plan.conditions.append(Condition(name, op, literal))
        if not r.accept("AND"):
            return


def _between(r: _Reader, plan: Plan) -> None:
    plan.start = r.timestamp()
    r.expect("AND")
    plan.end = r.timestamp()


def _find(r: _Reader, plan: Plan) -> None:
    _targets(r, plan)
    while True:
        if r.accept("WHERE"):
            _where(r, plan)
        elif r.accept("BETWEEN"):
            _between(r, plan)
        elif r.accept("ORDER"):
            r.expect("BY")
            plan.order_by = r.expect("name").value
            plan.descending = False
            if turn := r.accept("ASC", "DESC"):
                plan.descending = turn.value == "DESC"
        elif r.accept("LIMIT"):
            n = r.expect("number")
            if n.value < 0:
                raise QueryError("LIMIT is not negative", n.line, n.column)
            plan.limit = int(n.value)
        else:
            return


def _analyze(r: _Reader, plan: Plan) -> None:
    _targets(r, plan)
    while True:
        if r.accept("WHERE"):
            _where(r, plan)
        elif r.accept("BETWEEN"):
            _between(r, plan)
        elif r.accept("GROUP"):
            r.expect("BY")
            unit = r.expect("name")
            if unit.value.lower() not in ("minute", "hour", "day"):
                raise QueryError(f"cannot group by {unit.value}", unit.line, unit.column)
            plan.group_by = unit.value.lower()
        else:
            return


def _diff(r: _Reader, plan: Plan) -> None:
    if name := r.accept("name", "string"):
        plan.entity = name.value
    r.expect("FROM")
    plan.start = r.timestamp()
    r.expect("TO")
    plan.end = r.timestamp()


def _state(r: _Reader, plan: Plan) -> None:
    if name := r.accept("name", "string"):
        plan.entity = name.value
    r.expect("AS")
    r.expect("OF")
    plan.at = r.timestamp()
