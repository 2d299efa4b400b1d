"""Find queries: ``FIND RUNS WHERE <condition> AND ...`` to conditions.

Conditions on runs: ``checkpoint="sha"``, ``tag="v"``, ``tag:k=v``, ``prompt CONTAINS "text"``,
``flag="name"``. Conditions on cells: ``ADDRESS [AT token[s][=]A[..B] [AGG]] OP NUMBER`` with AGG one of
MAX, MIN, MEAN, P95, MAX_WINDOW; without AT, all tokens. A comparison of cohorts,
``COMPARE GROUPS a, b ON ADDRESS[, ...] [AT tokens A..B] [WITH STATS s, ...]``, is parsed too. Quoted
text is one token, so it may hold AND.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from tapelark.errors import BadInput
from tapelark.functions.addresses import Span, parse

OPS = (">=", "<=", "==", "!=", ">", "<", "=")
AGGREGATES = ("MAX", "MIN", "MEAN", "P95", "MAX_WINDOW")
FLAGS = ("bad_output", "ring_overflow", "hash_fail")
_token = re.compile(r'\s*("(?:[^"\\]|\\.)*"|>=|<=|==|!=|[><=]|,|[^\s"<>=!,]+)')


@dataclass(frozen=True)
class RunCond:
    """A condition on a run: kind is checkpoint, tag, prompt or flag."""

    kind: str
    value: str


@dataclass(frozen=True)
class CellCond:
    """A condition on cells: aggregate VALUE compares the one token low, others tokens low..high; high null is the last."""

    span: Span
    low: int
    high: int | None
    aggregate: str
    op: str
    value: float


@dataclass(frozen=True)
class Find:
    runs: tuple[RunCond, ...]
    cells: tuple[CellCond, ...]


@dataclass(frozen=True)
class Compare:
    groups: tuple[RunCond, ...]
    spans: tuple[Span, ...]
    low: int
    high: int
    stats: tuple[str, ...]


def _lex(text: str) -> list[str]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        found = _token.match(text, at)
        if not found:
            raise BadInput(f"cannot read the query at {text[at : at + 20]!r}\n  {text}\n  {' ' * at}^")
        out.append(found[1])
        at = found.end()
    return out


def _quoted(token: str) -> str:
    if len(token) < 2 or token[0] != '"':
        raise BadInput(f"quoted text expected, not {token!r}")
    return re.sub(r"\\(.)", r"\1", token[1:-1])


class _Reader:
    def __init__(self, text: str) -> None:
        self.tokens, self.at = _lex(text), 0

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ""

    def take(self, what: str = "") -> str:
        got = self.peek()
        if not got or what and got.upper() != what.upper():
            raise BadInput(f"{what or 'more'} expected, not {got or 'the end'!r}")
        self.at += 1
        return got

    def skip(self, *words: str) -> bool:
        if all(self.peek(k).upper() == w for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False


def token_range(text: str) -> tuple[int, int]:
    """``A..B`` or ``A``, both ends included."""
    found = re.fullmatch(r"(\d+)(?:\.\.(\d+))?", text.strip())
    if not found or found[2] and int(found[2]) < int(found[1]):
        raise BadInput(f"bad token range {text!r}")
    return int(found[1]), int(found[2] or found[1])


def _at(r: _Reader) -> tuple[int, int] | None:
    if not r.skip("AT"):
        return None
    word = r.take()
    if word.lower() not in ("token", "tokens"):
        raise BadInput(f"token or tokens expected, not {word!r}")
    r.skip("=")
    return token_range(r.take())


def _cell(r: _Reader) -> CellCond:
    span = parse(r.take())
    at = _at(r)
    aggregate = r.take().upper() if r.peek().upper() in AGGREGATES else ""
    op = r.take()
    if op not in OPS:
        raise BadInput(f"comparison expected, not {op!r}")
    try:
        value = float(r.take())
    except ValueError as e:
        raise BadInput("number expected after the comparison") from e
    if value != value:
        raise BadInput("nothing compares with NaN")
    single = at is not None and at[0] == at[1]
    aggregate = "VALUE" if single else "MAX" if aggregate in ("", "MAX_WINDOW") else aggregate
    low, high = at or (0, None)
    return CellCond(span, low, high, aggregate, "=" if op == "==" else op, value)


def group(text: str) -> RunCond:
    """A cohort: ``tag:k=v``, ``tag="v"`` or ``checkpoint=sha``."""
    r = _Reader(text)
    cond = _run(r)
    if cond is None or cond.kind not in ("tag", "checkpoint") or r.peek():
        raise BadInput(f"bad group {text!r}; tag:k=v or checkpoint=sha")
    return cond


def _run(r: _Reader) -> RunCond | None:
    word, following = r.peek(), r.peek(1)
    low = word.lower()
    if low.startswith("tag:") and len(word) > 4:
        key = r.take()[4:]
        r.take("=")
        value = r.take()
        return RunCond("tag", f"{key}={_quoted(value) if value[0] == '"' else value}")
    if low in ("checkpoint", "tag", "flag") and following in ("=", "=="):
        r.at += 2
        value = r.take()
        value = _quoted(value) if value[0] == '"' or low != "checkpoint" else value
        if low == "flag" and value not in FLAGS:
            raise BadInput(f"unknown flag {value!r}; one of {', '.join(FLAGS)}")
        return RunCond(low, value.replace("sha256:", "") if low == "checkpoint" else value)
    if low == "prompt" and following.upper() == "CONTAINS":
        r.at += 2
        return RunCond("prompt", _quoted(r.take()))
    return None


def parse_find(text: str) -> Find:
    r = _Reader(text)
    r.skip("FIND", "RUNS", "WHERE")
    runs, cells = [], []
    while True:
        cond = _run(r)
        if cond is not None:
            runs.append(cond)
        else:
            cells.append(_cell(r))
        if not r.peek():
            return Find(tuple(runs), tuple(cells))
        r.take("AND")


def parse_compare(text: str) -> Compare:
    r = _Reader(text)
    if not r.skip("COMPARE", "GROUPS"):
        raise BadInput("COMPARE GROUPS expected")
    groups = [_run(r)]
    while r.skip(","):
        groups.append(_run(r))
    if None in groups:
        raise BadInput("bad group in COMPARE")
    r.take("ON")
    spans = [parse(r.take())]
    while r.skip(","):
        spans.append(parse(r.take()))
    low, high = _at(r) or (15, 20)
    stats = []
    if r.skip("WITH", "STATS"):
        stats.append(r.take().lower())
        while r.skip(","):
            stats.append(r.take().lower())
    if r.peek():
        raise BadInput(f"unexpected {r.peek()!r}")
    return Compare(tuple(groups), tuple(spans), low, high, tuple(stats) or ("mean", "p95", "firing_rate"))
