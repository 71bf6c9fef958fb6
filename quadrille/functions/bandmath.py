"""Band math: a small expression language that compiles to a Column, never through SQL text.

Numbers, names, parentheses, unary and binary ``+ - * /``, and the functions abs, sqrt, log, exp,
min, max and pow. A null operand gives null; so does what leaves the real numbers.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|([-+*/(),]))")
_ARITY = {"abs": 1, "sqrt": 1, "log": 1, "exp": 1, "min": 2, "max": 2, "pow": 2}


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at]!r} at {at}")
        out.append(("number", m[1]) if m[1] else ("name", m[2]) if m[2] else ("sign", m[3]))
        at = m.end()
    return [*out, ("end", "")]


def _real(c: Column) -> Column:
    """``c``, null where it is no number or infinite."""
    return F.when(F.abs(c) < float("inf"), c)


def _call(name: str, args: list[Column]) -> Column:
    a, b = args[0], args[-1]
    if name == "abs":
        return F.abs(a)
    if name == "sqrt":
        return F.when(a >= 0, F.sqrt(a))
    if name == "log":
        return F.when(a > 0, F.log(a))
    if name == "exp":
        return _real(F.exp(a))
    if name == "pow":
        return _real(F.pow(a, b))
    # least and greatest skip nulls; here null spreads
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b) if name == "min" else F.greatest(a, b))


def compile_expression(text: str, names: Mapping[str, Column], divide_by_zero: str = "nodata") -> Column:
    """The Column of ``text`` over ``names``. ``divide_by_zero``: ``nodata`` or ``zero``."""
    tokens, at = _tokens(text), 0

    def take(sign: str | None = None) -> tuple[str, str]:
        nonlocal at
        token = tokens[at]
        if sign is not None and token != ("sign", sign):
            raise ValueError(f"expected {sign!r}, found {token[1]!r}")
        at += 1
        return token

    def factor() -> Column:
        kind, value = take()
        if kind == "number":
            return F.lit(float(value))
        if (kind, value) == ("sign", "("):
            inner = total()
            take(")")
            return inner
        if kind == "sign" and value in "+-":
            return factor() if value == "+" else -factor()
        if kind != "name":
            raise ValueError(f"unexpected {value or 'end'!r}")
        if tokens[at] != ("sign", "("):
            if value not in names:
                raise ValueError(f"unknown name {value!r}")
            return names[value]
        if value not in _ARITY:
            raise ValueError(f"unknown function {value!r}")
        take("(")
        args = [total()]
        while tokens[at] == ("sign", ","):
            take()
            args.append(total())
        take(")")
        if len(args) != _ARITY[value]:
            raise ValueError(f"{value} takes {_ARITY[value]} arguments")
        return _call(value, args)

    def product() -> Column:
        out = factor()
        while tokens[at][0] == "sign" and tokens[at][1] in "*/":
            if take()[1] == "*":
                out = out * factor()
            else:
                below = factor()
                quotient = F.try_divide(out, below)
                out = quotient if divide_by_zero == "nodata" else F.when(below == 0, 0.0).otherwise(quotient)
        return out

    def total() -> Column:
        out = product()
        while tokens[at][0] == "sign" and tokens[at][1] in "+-":
            out = out + product() if take()[1] == "+" else out - product()
        return out

    result = total()
    if tokens[at][0] != "end":
        raise ValueError(f"unexpected {tokens[at][1]!r}")
    return _real(result)
