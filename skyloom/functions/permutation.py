"""Keyed permutations of 0 to n - 1 as column arithmetic: a shuffled pass without sort or shuffle, resumable at any item."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half rounds; each mixes one digit of a number by a hash of the other.
HALF_ROUNDS = 8
# Primes below 2**31 and multipliers of the rounds' hash.
P, Q, A, C = 2147483647, 2147483629, 1103515245, 1664525


def _key(seed: int, epoch: int, i: int) -> int:
    """A number below P for each half round of an epoch."""
    x = (seed * 1_000_003 + epoch) * 31 + i
    for _ in range(3):
        x = (x * A + 12345) % P
        x ^= x >> 11
    return x % P


def _mixed(x: Column, key: int) -> Column:
    """A hash of a digit, the same in any SQL with 64-bit integers; digits are below 2**31."""
    p, q, a, c, k = (_long(v) for v in (P, Q, A, C, key))
    return ((x % p * a + k) % p * c + k) % q


def _long(v: int) -> Column:
    """Literals of the columns' own type, so that the analyser has nothing to adapt in long expressions."""
    return F.lit(v).cast("long")


def _digits(n: Column) -> tuple[Column, Column]:
    """Two radices whose product is n or up to sqrt(n) above it."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    return a, F.call_function("div", n + a - _long(1), a)


def _once(x: Column, n: Column, keys: list[int], back: bool) -> Column:
    """One walk over the digits (high, low): each half round adds to one a hash of the other, modulo its radix."""
    a, b = _digits(n)
    high, low = F.call_function("div", x, b), x % b
    for i in reversed(range(len(keys))) if back else range(len(keys)):
        if i % 2 == 0:
            high = F.pmod(high - _mixed(low, keys[i]) if back else high + _mixed(low, keys[i]), a)
        else:
            low = F.pmod(low - _mixed(high, keys[i]) if back else low + _mixed(high, keys[i]), b)
    return high * b + low


def _walked(x: Column, n: Column, keys: list[int], back: bool) -> Column:
    """Walks until the number is below n again: at most sqrt(n) numbers lie above, so a second walk is rare.

    Only rows that need it pay for the interpreted loop; it ends, as a cycle comes back to where it began.
    """
    y = _once(x, n, keys, back)
    # of n beyond 2**24 a row needs over 64 walks once in 2**768; of lower ones at most sqrt(n) numbers can be in the way
    steps = F.sequence(F.lit(1), F.when(n < 1 << 24, _digits(n)[0].cast("int")).otherwise(F.lit(64)))
    more = F.aggregate(steps, y, lambda at, _: F.when(at < n, at).otherwise(_once(at, n, keys, back)))
    return F.when(y < n, y).otherwise(more)


def permuted(item: Column, n: Column | int, seed: int, epoch: int = 0) -> Column:
    """Position of an item (0 to n - 1) in the order of an epoch; a bijection for any n below 2**62."""
    return _walked(item.cast("long"), _long(n) if isinstance(n, int) else n.cast("long"), [_key(seed, epoch, i) for i in range(HALF_ROUNDS)], back=False)


def item_at(position: Column, n: Column | int, seed: int, epoch: int = 0) -> Column:
    """The item at a position of an epoch: the inverse of ``permuted``."""
    return _walked(position.cast("long"), _long(n) if isinstance(n, int) else n.cast("long"), [_key(seed, epoch, i) for i in range(HALF_ROUNDS)], back=True)


def permuted_sql(source: str, n: str, seed: int, epoch: int = 0) -> str:
    """Recursive SQL of item and position for a query with the columns item and n."""
    keys = [_key(seed, epoch, i) for i in range(HALF_ROUNDS)]
    mixed = lambda x, k: f"(((({x}) % {P} * {A} + {k}) % {P} * {C} + {k}) % {Q})"
    step = "SELECT item, n, a, b, {x} // b AS high, {x} % b AS low FROM {source}"
    for i, k in enumerate(keys):
        step = f"SELECT item, n, a, b, {f'(high + {mixed("low", k)}) % a AS high, low' if i % 2 == 0 else f'high, (low + {mixed("high", k)}) % b AS low'} FROM ({step})"
    walk = f"SELECT item, n, a, b, high * b + low AS x FROM ({step})"
    radices = f"SELECT item, n, a, CAST(ceil(n / a) AS BIGINT) AS b, item AS x FROM (SELECT item, n, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM ({source}))"
    fill = lambda source: walk.replace("{x}", "x").replace("{source}", source)
    return f"(WITH RECURSIVE w AS (SELECT * FROM ({fill(f'({radices})')}) UNION ALL SELECT * FROM ({fill('(SELECT * FROM w WHERE x >= n)')})) SELECT item, x AS position FROM w WHERE x < n)"
