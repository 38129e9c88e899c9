"""Keyed permutations of the numbers below n, without a table.

Numbers are pairs (l, r) of a grid a x b that just holds n; four Feistel rounds
add a hash of one half to the other, modulo its range, so every round can be
undone.  The grid has fewer than a numbers too many: one that falls on such a
number goes on until it is below n (cycle walking).  The longest walk is known
beforehand, as only those few numbers walk.
"""

from __future__ import annotations

import hashlib
import math

ROUNDS = 4


def grid(n: int) -> tuple[int, int]:
    a = math.isqrt(max(0, n - 1)) + 1
    return a, -(-n // a)


def _hash(seed: int, stream: str, k: int, half: int) -> int:
    return int(hashlib.md5(f"{seed}:{stream}/{k}:{half}".encode()).hexdigest()[:8], 16)


def _step(x: int, n: int, seed: int, stream: str, back: bool = False) -> int:
    a, b = grid(n)
    l, r = divmod(x, b)
    sign = -1 if back else 1
    for k in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
        if k % 2:
            r = (r + sign * _hash(seed, stream, k, l)) % b
        else:
            l = (l + sign * _hash(seed, stream, k, r)) % a
    return l * b + r


def permuted(x: int, n: int, seed: int, stream: str = "order", back: bool = False) -> int:
    """The place of x, or with `back` what is at place x."""
    x = _step(x, n, seed, stream, back)
    while x >= n:
        x = _step(x, n, seed, stream, back)
    return x


def longest_walk(n: int, seed: int, stream: str = "order") -> int:
    """Steps that any number takes at most; looks at the fewer than sqrt(n) + 1 numbers of the grid from n on."""
    a, b = grid(n)
    far: dict[int, int] = {}
    for start in range(n, a * b):
        chain, x = [], start
        while x >= n and x not in far:
            chain.append(x)
            x = _step(x, n, seed, stream)
            if x == start:  # a cycle of such numbers alone, which nothing below n enters
                break
        steps = far.get(x, 0)
        for y in reversed(chain):
            steps += 1
            far[y] = steps
    return 1 + max(far.values(), default=0)


def permuted_column(x: str, n: int, seed: int, stream: str = "order") -> str:
    """SQL for Spark of permuted(x, n, seed): x is SQL of a number below n."""
    a, b = grid(n)
    state = f"named_struct('l', x div {b}L, 'r', x % {b}L)"
    for k in range(ROUNDS):
        added = lambda half: f"cast(conv(substring(md5(concat('{seed}:{stream}/{k}:', cast(s.{half} as string))), 1, 8), 16, 10) as bigint)"  # noqa: E731, B023
        new = f"named_struct('l', s.l, 'r', (s.r + {added('l')}) % {b}L)" if k % 2 else f"named_struct('l', (s.l + {added('r')}) % {a}L, 'r', s.r)"
        state = f"transform(array({state}), s -> {new})[0]"
    once = f"transform(array({state}), s -> s.l * {b}L + s.r)[0]"
    return f"aggregate(sequence(1, {longest_walk(n, seed, stream)}), cast({x} as bigint), (x, i) -> if(i > 1 and x < {n}L, x, {once}))"


def permuted_sql(source: str, k: str, n: str, seed: int, stream: str = "order") -> str:
    """DuckDB query (k, place) for the numbers k of source, which has its row count as n: rounds as nested queries, walks by recursion."""
    added = lambda j, half: f"('0x' || substr(md5('{seed}:{stream}/{j}:' || {half}::varchar), 1, 8))::bigint"
    inner = "select k, n, a, b, x // b as l0, x % b as r0 from ({})"
    rounds = f"select k, n, a, b, l2 * b + r2 as x from (select *, (r1 + {added(3, 'l2')}) % b as r2 from (select *, (l1 + {added(2, 'r1')}) % a as l2 from (select *, (r0 + {added(1, 'l1')}) % b as r1 from (select *, (l0 + {added(0, 'r0')}) % a as l1 from ({{}})))))"
    sized = f"select {k} as k, {n} as n, (floor(sqrt({n} - 1)) + 1)::bigint as a, ceil({n} / (floor(sqrt({n} - 1)) + 1))::bigint as b, {k}::bigint as x from {source}"
    first, again = rounds.format(inner.format(sized)), rounds.format(inner.format("select * from walk where x >= n"))
    return f"with recursive walk as ({first} union all {again}) select k, x as place from walk where x < n"
