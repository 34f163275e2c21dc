"""The session's 64-bit hash function as SQL, to replay hash orders and hash choices."""

from __future__ import annotations

from profilar.operators import permute

# fixed values of the hash: its five primes, and the seed of the session's hash function
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
SEED = 42


def _times(x: str, factor: int) -> str:
    """Product modulo 2^64."""
    return f"(({x})::uhugeint * {factor}::uhugeint % 18446744073709551616::uhugeint)::ubigint"


def _plus(x: str, addend: int) -> str:
    return f"((({x})::uhugeint + {addend}::uhugeint) % 18446744073709551616::uhugeint)::ubigint"


def _turned(x: str, bits: int) -> str:
    high = f"(({x})::uhugeint * {1 << bits}::uhugeint % 18446744073709551616::uhugeint)::ubigint"
    return f"({high} | ({x} >> {64 - bits}))"


def unsigned(x: str) -> str:
    """A signed 64-bit number as the unsigned one of the same bits."""
    return f"(({x})::hugeint & 18446744073709551615::hugeint)::ubigint"


def signed(x: str) -> str:
    return f"(CASE WHEN {x} >= 9223372036854775808 THEN {x}::hugeint - 18446744073709551616::hugeint ELSE {x}::hugeint END)::bigint"


def hash_steps(source: str, value: str, seed: str, name: str, *, kind: str = "bigint") -> str:
    """CTEs up to ``name``: the rows of ``source`` with the hash ``h`` of ``value`` under ``seed`` (unsigned).

    ``kind``: the value's type; an ``int`` must not be negative.
    """
    p1, p2, p3, p4, p5 = PRIMES
    if kind == "bigint":
        mixed = f"xor(s0, {_times(_turned('k0', 31), p1)})", _plus(_times(_turned("s1", 27), p1), p4)
        k0, size = _times(unsigned(value), p2), 8
    else:
        mixed = f"xor(s0, {_times('k0', p1)})", _plus(_times(_turned("s1", 23), p2), p3)
        k0, size = f"({value})::ubigint", 4
    return f"""
      {name}_1 as (select *, {k0} as k0, {_plus(seed, p5 + size)} as s0 from {source}),
      {name}_2 as (select *, {mixed[0]} as s1 from {name}_1),
      {name}_3 as (select *, {mixed[1]} as s2 from {name}_2),
      {name}_4 as (select *, {_times('xor(s2, s2 >> 33)', p2)} as s3 from {name}_3),
      {name}_5 as (select *, {_times('xor(s3, s3 >> 29)', p3)} as s4 from {name}_4),
      {name} as (select * exclude (k0, s0, s1, s2, s3, s4), xor(s4, s4 >> 32) as h from {name}_5)"""


def _mixed(source: str, value: str, out: str, keep: str) -> str:
    """Subquery over ``source``: the columns ``keep`` and the 64-bit mix ``out`` of ``value`` (unsigned)."""
    one = f"(select {keep}, {value} as z0 from {source})"
    two = f"(select {keep}, {_times('xor(z0, z0 >> 30)', permute.FIRST)} as z1 from {one})"
    three = f"(select {keep}, {_times('xor(z1, z1 >> 27)', permute.SECOND)} as z2 from {two})"
    return f"(select {keep}, xor(z2, z2 >> 31) as {out} from {three})"


def permutations(source: str, key: str, stratum: str, n_perm: int, seed: int = 1) -> str:
    """CTE ``moved``: for each permutation ``b`` and row, its key and the key ``onto`` whose place it takes in its stratum.

    A recursive CTE: every step takes the rows whose place is still outside of their stratum through the rounds.
    """
    names = [f"k{k}" for k in range(permute.ROUNDS)]
    number = f"(b * {permute.ROUNDS} + r)"
    keyed = _mixed(_mixed(f"(select b, r, {_plus(_times(number, permute.STEP), seed)} as x from range(1, {n_perm + 1}) p(b), "
                          f"range({permute.ROUNDS}) q(r))", "x", "y", "b, r"), "y", "k", "b, r")
    carried = f"b, key, stratum, n, a, {', '.join(names)}"
    step = f"(select {carried}, spot // a as high, spot % a as low from pm_walk where spot >= n or not begun)"
    for k in names:
        turned = f"({k}::uhugeint + low::uhugeint * {permute.STEP}::uhugeint) % 18446744073709551616::uhugeint"
        mixed = _mixed(step, f"({turned})::ubigint", "m", f"{carried}, high, low")
        step = f"(select {carried}, low as high, (high + m % a) % a as low from {mixed})"
    return f"""
      pm_keys as (select b, {', '.join(f'max(k) filter (r = {k}) as k{k}' for k in range(permute.ROUNDS))} from {keyed} group by b),
      pm_rows as (select {key} as key, {stratum} as stratum, row_number() over w as place, count(*) over (partition by {stratum}) as n
                  from {source} window w as (partition by {stratum} order by {key})),
      pm_walk as (
        select {carried}, (place - 1)::ubigint as spot, false as begun
        from (select *, ceil(sqrt(n))::ubigint as a from pm_rows), pm_keys
        union all select {carried}, high * a + low as spot, true as begun from {step}),
      moved as (select t.b, t.key, r.key as onto from pm_walk t join pm_rows r
                on r.place = t.spot::bigint + 1 and r.stratum is not distinct from t.stratum where t.begun and t.spot < t.n)"""
