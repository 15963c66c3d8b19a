"""Reproducible randomness: a 32-bit integer hash of (pair, y, x, round, salt).

``rand()`` depends on the partitioning; this does not, so every field is the same for any
cluster size and can be recomputed in plain SQL. Only long arithmetic is used, which stays in
generated code (an md5 based draw costs string conversions per candidate).

All functions return SQL text: an expression of hundreds of nodes is one call to the JVM then.
"""

from __future__ import annotations

from nnfield.functions.text import subquery

# Fixed values. Multipliers are below 2^31, so no product of two 32-bit numbers overflows a BIGINT.
MASK = 4294967295
PAIR_BITS = 2147483647
KEY_WEIGHTS = (1540483477, 668265263, 374761393, 2057094137, 1103515245)
MIX_STEPS = ((15, 739982445), (12, 695872825))
MIX_LAST = 15

SALT_Y = 0
SALT_X = 1


def key_of(pair: str, y: str, x: str, round_no: str) -> str:
    """The part of the hash input all draws of a pixel and round share."""
    p, q, r, s, _ = KEY_WEIGHTS
    return f"({pair} & {PAIR_BITS}L) * {p}L + {y} * {q}L + {x} * {r}L + {round_no} * {s}L"


def with_draws(source: str, kept: list[str], draws: dict[str, str], key: str = "key") -> str:
    """Subquery adding uniform BIGINT columns in [0, 2^32), one per name and salt, from column ``key``.

    Every mixing step reads its input twice, so each is a projection of its own: nested in one
    expression the steps would multiply.
    """
    mixed = [f"({key} + ({salt}) * {KEY_WEIGHTS[4]}L) & {MASK}L as {n}" for n, salt in draws.items()]
    source = subquery([*kept, *mixed], source)
    for bits, multiplier in MIX_STEPS:
        step = [f"(({n} ^ shiftrightunsigned({n}, {bits})) * {multiplier}L) & {MASK}L as {n}" for n in draws]
        source = subquery([*kept, *step], source)
    return subquery([*kept, *[f"{n} ^ shiftrightunsigned({n}, {MIX_LAST}) as {n}" for n in draws]], source)


def pick_between(low: str, high: str, drawn: str) -> str:
    """A draw as an INT in [low, high)."""
    return f"cast({low} + {drawn} % ({high} - {low}) as int)"
