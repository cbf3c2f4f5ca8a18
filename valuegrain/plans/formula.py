"""Formulas over named parents, turned into Columns.

The grammar is closed: decimals, the letters a to z for parents 0 to 25, ``+ - * / % ^`` and parentheses.
Usual precedence: power binds tighter than a sign and to the right, the others to the left; division is
a float's, and an undefined result is null. A formula is translated once however many claims use it: into a Column where
the formulas are given, or in the tasks that have its claims, where a batch's claims of formulas that differ in their decimals only
are computed together.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of an admitted formula.
MAX_BYTES, MAX_DEPTH, MAX_PARENTS = 4096, 256, 26
#: Formulas, and shapes of formulas, that a task remembers.
MOST_REMEMBERED = 10_000
_TOKEN = re.compile(r"\s*(?:((?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)|([a-z])(?![A-Za-z0-9_])|(.))", re.S)
_LEVELS = ("+-", "*/%")


class FormulaError(ValueError):
    """Text outside the grammar."""


def admitted(text: str) -> bool:
    depth = most = 0
    for c in text:
        depth += (c == "(") - (c == ")")
        most = max(most, depth)
    return bool(text.strip()) and len(text.encode()) <= MAX_BYTES and most <= MAX_DEPTH


def tokenise(text: str) -> list[str]:
    out = []
    for number, name, other in _TOKEN.findall(text.rstrip()):
        if other and other not in "+-*/%^()":
            raise FormulaError(f"unexpected {other!r}")
        out.append(number or name or other)
    return out


def names(text: str) -> set[int]:
    """Parents that a formula refers to."""
    return {ord(t) - 97 for t in tokenise(text) if len(t) == 1 and "a" <= t <= "z"}


class OfColumns:
    """Formulas over an array column of doubles."""

    def __init__(self, parents: Column):
        self.parents = parents

    def number(self, x: float) -> Column:
        return F.lit(x)

    def parent(self, i: int) -> Column:
        return F.get(self.parents, F.lit(i))

    def minus(self, x: Column) -> Column:
        return -x

    def apply(self, op: str, x: Column, y: Column) -> Column:
        if op == "/":
            return F.try_divide(x, y)
        if op == "%":
            return F.when(y != 0, F.try_mod(x, y))
        return {"+": x + y, "-": x - y, "*": x * y, "^": F.pow(x, y)}[op]


Kernel = Callable[[np.ndarray], np.ndarray]


class OfArrays:
    """The same formulas over a matrix of doubles, a row for each parent; what is undefined is NaN."""

    def number(self, x: float) -> Kernel:
        return lambda p: np.full(p.shape[1], x)

    def parent(self, i: int) -> Kernel:
        return lambda p: p[i]

    def minus(self, x: Kernel) -> Kernel:
        return lambda p: -x(p)

    def apply(self, op: str, x: Kernel, y: Kernel) -> Kernel:
        own = {"+": np.add, "-": np.subtract, "*": np.multiply, "/": _divided, "%": _rest, "^": np.power}[op]
        return lambda p: own(x(p), y(p))


class OfShapes(OfArrays):
    """Formulas of one shape: their decimals, in order, are further rows of the matrix, below the parents."""

    def __init__(self, n_parents: int):
        self.at = n_parents - 1

    def number(self, x: float) -> Kernel:
        self.at += 1
        return self.parent(self.at)


def _divided(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.where(y == 0, math.nan, np.divide(x, y))


def _rest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.where(y == 0, math.nan, np.fmod(x, y))


def translated(text: str, algebra: OfColumns | OfArrays) -> Column | Kernel:
    """The formula in an algebra."""
    if not admitted(text):
        raise FormulaError("empty, too long or too deep")
    return of_tokens(tokenise(text), algebra)


def of_tokens(tokens: Sequence[str], algebra: OfColumns | OfArrays) -> Column | Kernel:
    """The formula of some tokens in an algebra, which meets its decimals from left to right."""
    rest = list(tokens)[::-1]

    def atom() -> Column | Kernel:
        if not rest:
            raise FormulaError("it ends too early")
        t = rest.pop()
        if t == "(":
            inner = chain(0)
            if not rest or rest.pop() != ")":
                raise FormulaError("a parenthesis isn't closed")
            return inner
        if "a" <= t <= "z":
            return algebra.parent(ord(t) - 97)
        if t in "+-*/%^)":
            raise FormulaError(f"unexpected {t!r}")
        return algebra.number(float(t))

    def signed() -> Column | Kernel:
        if rest and rest[-1] in "+-":
            return algebra.minus(signed()) if rest.pop() == "-" else signed()
        base = atom()
        if rest and rest[-1] == "^":
            rest.pop()
            return algebra.apply("^", base, signed())
        return base

    def chain(level: int) -> Column | Kernel:
        part = signed if level + 1 == len(_LEVELS) else lambda: chain(level + 1)
        left = part()
        while rest and rest[-1] in _LEVELS[level]:
            left = algebra.apply(rest.pop(), left, part())
        return left

    out = chain(0)
    if rest:
        raise FormulaError(f"unexpected {rest[-1]!r}")
    return out


def to_column(text: str, parents: Column) -> Column:
    """The formula over an array of doubles."""
    return translated(text, OfColumns(parents))


def _shape(text: str) -> tuple[tuple[str, ...], tuple[float, ...]] | None:
    """(tokens with 0 for each decimal, the decimals) of a formula; none for text that isn't admitted."""
    try:
        tokens = tokenise(text) if admitted(text) else []
    except FormulaError:
        return None
    is_number = [t[0] in ".0123456789" for t in tokens]
    return (tuple("0" if x else t for t, x in zip(tokens, is_number)), tuple(float(t) for t, x in zip(tokens, is_number) if x)) if tokens else None


@lru_cache(MOST_REMEMBERED)
def _kernel(shape: tuple[str, ...]) -> tuple[Kernel | None, int]:
    """(kernel, parents); no kernel for tokens outside the grammar or that leave one of the first parents out."""
    used = {ord(t) - 97 for t in shape if "a" <= t <= "z"}
    try:
        return (of_tokens(shape, OfShapes(len(used))), len(used)) if len(used) == max(used, default=-1) + 1 else (None, 0)
    except FormulaError:
        return None, 0


def evaluated(texts: list[str | None], parents: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, known) of a batch: its rows are grouped by their formulas' shapes, and each shape is computed once over all of its rows."""
    rows_of, groups = defaultdict(list), defaultdict(list)
    for i, text in enumerate(texts):
        if text is not None:
            rows_of[text].append(i)
    for text, own in rows_of.items():
        shape = _shape(text)
        if shape is not None:
            groups[shape[0]].append((own, shape[1]))
    values, known = np.full(len(texts), math.nan), np.zeros(len(texts), bool)
    starts = parents.offsets.to_numpy()
    flat = parents.values.to_numpy(zero_copy_only=False).astype(float)  # nulls are NaN
    counts, some = np.diff(starts), parents.is_valid().to_numpy(zero_copy_only=False)
    with np.errstate(all="ignore"):
        for shape, members in groups.items():
            kernel, n = _kernel(shape)
            if kernel is None:
                continue
            rows = np.array([i for own, _ in members for i in own])
            decimals = np.repeat(np.array([d for _, d in members], float), [len(own) for own, _ in members], axis=0)
            fits = some[rows] & (counts[rows] == n)
            rows, decimals = rows[fits], decimals[fits]
            if len(rows):
                values[rows] = kernel(np.vstack([flat[starts[rows] + np.arange(n)[:, None]], decimals.T]))
                known[rows] = True
    return values, known


def in_tasks(expression: Column, parents: Column) -> Column:
    """Struct (value, known) of each row's own formula, however many there are; only these two columns go to Python."""

    @F.arrow_udf("value double, known boolean")
    def run(texts: pa.Array, own: pa.Array) -> pa.Array:
        values, known = evaluated(texts.to_pylist(), own)
        return pa.StructArray.from_arrays([pa.array(values, mask=~np.isfinite(values)), pa.array(known)], names=["value", "known"])

    return run(expression, parents)


def evaluate(formulas: Iterable[str], expression: Column, parents: Column) -> tuple[Column, Column]:
    """(value, admitted) of a row's formula among the distinct ones given; formulas outside the grammar aren't admitted."""
    value, known = F.lit(None).cast("double"), F.lit(False)
    for text in formulas:
        try:
            own, used = to_column(text, parents), names(text)
        except FormulaError:
            continue
        fits = (expression == text) & (F.size(parents) > max(used, default=-1)) & (F.size(parents) == F.lit(len(used)))
        value = F.when(fits, own).otherwise(value)
        known = known | fits
    return value, known


def referenced(expression: Column, n: Column) -> Column:
    """Whether each of the first ``n`` letters stands alone somewhere in the formula."""
    alone = lambda i: expression.rlike(f"(^|[^A-Za-z0-9_]){chr(97 + i)}($|[^A-Za-z0-9_])") | (n <= i)
    return reduce(lambda a, b: a & b, [alone(i) for i in range(MAX_PARENTS)])
