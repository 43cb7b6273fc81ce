"""Matching a node's bag of arcs against a triple expression (a regular bag expression).

Arcs come as counts by signature: which triple constraints an arc may stand for, and whether it may stay
over (its predicate is in EXTRA, with no constraint it fits, or it fits some and EXTRA tolerates it).
Expressions without repeated predicates never come here: they are interval tests in an aggregate.

As arcs have no order, an expression matches a bag just if a system of linear inequalities has a solution
in whole numbers: for each part, how often it is entered and repeated; for each signature and constraint,
how many arcs go there. The system has the size of the expression, whatever the counts, so a node of
any degree costs the same. It is solved exactly, by the simplex method in integers and branching.
"""

from __future__ import annotations

from math import gcd

UNBOUNDED = -1


class System:
    """Linear constraints over whole numbers >= 0."""

    def __init__(self):
        self.n, self.rows = 0, []  # rows: (coefficients, least): sum >= least, or equal

    def variable(self) -> dict[int, int]:
        self.n += 1
        return {self.n - 1: 1}

    def add(self, sum_: dict[int, int], least: int, equal: bool = False) -> None:
        self.rows.append((sum_, least, equal))


def _plus(a: dict[int, int], b: dict[int, int], times: int = 1) -> dict[int, int]:
    out = dict(a)
    for k, v in b.items():
        out[k] = out.get(k, 0) + v * times
    return out


def _vertex(n: int, rows: list) -> list[tuple[int, int]] | None:
    """A corner of the constraints' solutions as fractions, None if there is none."""
    slack = sum(not eq for *_, eq in rows)
    m, width = len(rows), n + slack
    table, s = [], n
    for sum_, least, eq in rows:
        row = [0] * (width + 1)
        for k, v in sum_.items():
            row[k] = v
        row[-1] = least
        if not eq:
            row[s], s = -1, s + 1
        if least < 0 or (least == 0 and not eq):
            row = [-x for x in row]
        table.append(row)
    basis, goal = [-1] * m, [0] * (width + 1)
    s = n
    for i, (_, least, eq) in enumerate(rows):
        if not eq:
            if table[i][s] > 0:
                basis[i] = s  # its slack is basic; other rows start with an error to be removed
            s += 1
        if basis[i] < 0:
            goal = [a + b for a, b in zip(goal, table[i], strict=True)]
    scale = 1  # goal / scale is the sum of errors
    while goal[-1] > 0:
        enter = next((j for j in range(width) if goal[j] > 0), None)  # Bland's rule
        if enter is None:
            return None
        leave = None
        for i in range(m):
            if table[i][enter] > 0:
                if leave is None:
                    leave = i
                    continue
                a, b = table[i][-1] * table[leave][enter], table[leave][-1] * table[i][enter]
                if a < b or (a == b and basis[i] < basis[leave]):
                    leave = i
        pivot = table[leave]
        p = pivot[enter]
        for i in range(m):
            q = table[i][enter]
            if i != leave and q:
                row = [x * p - y * q for x, y in zip(table[i], pivot, strict=True)]
                g = gcd(*row) or 1
                table[i] = [x // g for x in row]
        q = goal[enter]
        goal = [x * p - y * q for x, y in zip(goal, pivot, strict=True)]
        scale *= p
        basis[leave] = enter
        g = gcd(scale, *goal) or 1
        goal, scale = [x // g for x in goal], scale // g
    out = [(0, 1)] * n
    for i, b in enumerate(basis):
        if 0 <= b < n:
            out[b] = (table[i][-1], table[i][b])
    return out


def _solvable(n: int, rows: list) -> bool:
    todo = [rows]
    while todo:
        now = todo.pop()
        at = _vertex(n, now)
        if at is None:
            continue
        part = next((k for k, (a, b) in enumerate(at) if a % b), None)
        if part is None:
            return True
        a, b = at[part]
        todo += [[*now, ({part: -1}, -(a // b), False)], [*now, ({part: 1}, a // b + 1, False)]]
    return False


def matches(expr: tuple, bag: tuple[tuple[int, bool, int], ...]) -> bool:
    """Whether all arcs of `bag` (mask of constraints, may stay over, count) are used up by the expression.

    expr is ("t", i, lo, hi), ("each", parts, lo, hi) or ("one", parts, lo, hi).
    """
    s, total = System(), sum(n for *_, n in bag)
    takes: dict[int, dict[int, int]] = {}
    leaves = _leaves(expr)
    for mask, spare, count in bag:
        used: dict[int, int] = {}
        for i in leaves:
            if mask >> i & 1:
                x = s.variable()
                used |= x
                takes[i] = takes.get(i, {}) | x
        if spare:
            s.add({k: -v for k, v in used.items()}, -count)
        elif used:
            s.add(used, count, True)
        elif count:
            return False

    def within(what: dict, lo: int, hi: int, times: tuple[dict, int]) -> None:
        """lo * times <= what <= hi * times, where times is (sum, constant)."""
        most = lo + total if hi == UNBOUNDED else hi
        s.add(_plus(what, times[0], -lo), lo * times[1])
        s.add(_plus({k: -v for k, v in what.items()}, times[0], most), -most * times[1])

    def walk(e: tuple, times: tuple[dict, int]) -> None:
        kind, body, lo, hi = e
        if kind == "t":
            within(takes.get(body, {}), lo, hi, times)
            return
        if lo == hi:
            n = {k: v * lo for k, v in times[0].items()}, times[1] * lo
        else:
            n = s.variable(), 0
            within(n[0], lo, hi, times)
        if kind == "each":
            for p in body:
                walk(p, n)
            return
        left = {k: -v for k, v in n[0].items()}
        for p in body:
            x = s.variable()
            left = _plus(left, x)
            walk(p, (x, 0))
        s.add(left, n[1], True)

    walk(expr, ({}, 1))
    return _solvable(s.n, s.rows)


def _leaves(e: tuple) -> list[int]:
    return [e[1]] if e[0] == "t" else [i for p in e[1] for i in _leaves(p)]
