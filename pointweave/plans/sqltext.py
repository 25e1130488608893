"""Pieces of DuckDB SQL over vectors, which the catalogues put together."""

from __future__ import annotations

#: A zero vector of the tables' width.
ZERO = "list_transform(range(64), lambda i_: 0.0::DOUBLE)"


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def unit(v: str) -> str:
    """``v`` should be a column: it is stated three times."""
    return f"list_transform({v}, lambda e_: e_ / greatest(sqrt(list_dot_product({v}, {v})), 1e-8))"


def mix(a: str, b: str, share: str = "1") -> str:
    """a + share b"""
    return f"list_transform(list_zip({a}, {b}), lambda z_: z_[1] + ({share}) * z_[2])"


def clip(x: str, low: str = "0", high: str = "1") -> str:
    return f"least(greatest({x}, {low}), {high})"


def vsum(rows: str, keys: str, weight: str = "1") -> str:
    """(keys, s, w): weighted sums of the column ``vec``."""
    return f"""SELECT {keys}, array_agg(s ORDER BY pos) AS s, max(tw) AS w FROM (SELECT {keys}, pos, sum(w * val) AS s, sum(w) AS tw FROM
 (SELECT {keys}, {weight} AS w, generate_subscripts(vec, 1) AS pos, unnest(vec::DOUBLE[]) AS val FROM {rows}) u1 GROUP BY ALL) u2 GROUP BY {keys}"""


def sigmoid(x: str) -> str:
    return f"1 / (1 + exp(-({x})))"
