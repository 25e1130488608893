"""Vector expressions over array columns: all in the JVM, nothing collected.

Vectors are arrays of float or double; arithmetic is in double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v: ColumnLike) -> Column:
    return F.transform(col(v), lambda x: x.cast("double"))


def dot(v: ColumnLike, w: ColumnLike) -> Column:
    products = F.zip_with(col(v), col(w), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda a, x: a + x)


def norm(v: ColumnLike) -> Column:
    return F.sqrt(dot(v, v))


def scale(v: ColumnLike, s: ColumnLike) -> Column:
    return once(F.struct(col(v).alias("v"), col(s).alias("s")), lambda p: F.transform(p["v"], lambda x: x.cast("double") * p["s"]))


def add(v: ColumnLike, w: ColumnLike) -> Column:
    return F.zip_with(col(v), col(w), lambda x, y: x.cast("double") + y.cast("double"))


def subtract(v: ColumnLike, w: ColumnLike) -> Column:
    return F.zip_with(col(v), col(w), lambda x, y: x.cast("double") - y.cast("double"))


def once(x: Column, f) -> Column:
    """f(x) with ``x`` worked out once a row: within a lambda it would be once an element."""
    return F.transform(F.array(x), f)[0]


def l2_normalize(v: ColumnLike, eps: float = 1e-8) -> Column:
    """v / max(norm, eps): a zero vector stays zero. ``eps`` differs by caller."""
    paired = once(col(v), lambda x: F.struct(x.alias("v"), F.greatest(norm(x), F.lit(eps)).alias("length")))
    unit = once(paired, lambda p: F.transform(p["v"], lambda x: x.cast("double") / p["length"]))
    return F.when(col(v).isNotNull(), unit)


def cosine(v: ColumnLike, w: ColumnLike, eps: float = 1e-8) -> Column:
    return dot(v, w) / F.greatest(norm(v) * norm(w), F.lit(eps))


def disagreement(v: ColumnLike, w: ColumnLike) -> Column:
    """1 - cosine, held in [0, 2]."""
    return clip(1 - cosine(v, w), 0.0, 2.0)


def squared_distance(v: ColumnLike, w: ColumnLike) -> Column:
    d = F.zip_with(col(v), col(w), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda a, x: a + x)


def clip(x: ColumnLike, low: float, high: float) -> Column:
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def sigmoid(x: ColumnLike) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def logit(x: ColumnLike) -> Column:
    return F.log(col(x) / (1 - col(x)))


def blend(v: ColumnLike, w: ColumnLike, share: ColumnLike) -> Column:
    """(1 - share) v + share w."""
    s = col(share)
    return F.zip_with(col(v), col(w), lambda x, y: (1 - s) * x.cast("double") + s * y.cast("double"))


def relevancy(v: ColumnLike, positive: ColumnLike, negatives: list[ColumnLike], temperature: float = 10.0) -> Column:
    """The least pairwise softmax of the positive against each negative, which is the
    sigmoid of its margin over the best negative."""
    best = F.greatest(*[dot(v, n) for n in negatives]) if len(negatives) > 1 else dot(v, negatives[0])
    return sigmoid(F.lit(temperature) * (dot(v, positive) - best))


def half_even_u8(x: ColumnLike) -> Column:
    """round(255 x) with halves to even."""
    return F.rint(col(x) * 255).cast("int")


def binary_entropy(hits: ColumnLike, total: ColumnLike) -> Column:
    """Entropy in bits of hits / total; 0 with fewer than two votes or no doubt."""
    p = col(hits) / F.greatest(col(total), F.lit(1))
    sure = (col(total) < 2) | (col(hits) <= 0) | (col(hits) >= col(total))
    return F.when(sure, F.lit(0.0)).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))


def distribution(p: ColumnLike) -> Column:
    """An array as probabilities: uniform if it has no mass."""
    total = F.aggregate(as_double(p), F.lit(0.0), lambda a, x: a + x)
    n = F.size(col(p))
    return F.transform(col(p), lambda x: F.when(total > 0, x.cast("double") / total).otherwise(1 / n))


def kl(p: ColumnLike, q: ColumnLike) -> Column:
    """Sum of p ln(p / q) where both are positive."""
    terms = F.zip_with(col(p), col(q), lambda x, y: F.when((x > 0) & (y > 0), x * F.log(x / y)).otherwise(F.lit(0.0)))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def symmetric_kl(p: ColumnLike, q: ColumnLike, least: float = 1e-8) -> Column:
    """Half of KL(p, q) + KL(q, p), entries at least ``least``."""
    a, b = (F.transform(col(x), lambda y: F.greatest(y.cast("double"), F.lit(least))) for x in (p, q))
    terms = F.zip_with(a, b, lambda x, y: (x - y) * (F.log(x) - F.log(y)))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2


def renyi2(p: ColumnLike, q: ColumnLike) -> Column:
    """ln max(1, sum p^2 / q) over entries with positive q."""
    terms = F.zip_with(col(p), col(q), lambda x, y: F.when(y > 0, x * x / y).otherwise(F.lit(0.0)))
    return F.log(F.greatest(F.lit(1.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))


def kl_trust_region(target: ColumnLike, base: ColumnLike, limit: float, steps: int = 32) -> Column:
    """The mix base + t (target - base) of largest t found by ``steps`` bisections with
    KL(mix, base) <= limit; the target itself if it is within the limit."""

    def mixed(t: Column) -> Column:
        return F.zip_with(col(base), col(target), lambda b, x: b + t * (x - b))

    def halve(state: Column, _: Column) -> Column:
        mid = (state["lo"] + state["hi"]) / 2
        fits = kl(mixed(mid), base) <= limit
        return F.struct(F.when(fits, mid).otherwise(state["lo"]).alias("lo"), F.when(fits, state["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: s["lo"])
    return mixed(F.when(kl(col(target), base) <= limit, F.lit(1.0)).otherwise(found))


def inverse_distance_weight(near: ColumnLike, far: ColumnLike) -> Column:
    """The nearer of two sources' share in 255ths, halves to even."""
    return F.rint(255 * col(far) / F.greatest(col(near) + col(far), F.lit(1e-8))).cast("int")


def directional_weight(reliability: ColumnLike, v: ColumnLike, w: ColumnLike) -> Column:
    return col(reliability) * clip(cosine(v, w), 0.0, 1.0)


def agreement_confidence(cos: ColumnLike, floor: float) -> Column:
    """(cos - floor) / (1 - floor), held in [0, 1]."""
    return clip((col(cos) - floor) / (1 - floor), 0.0, 1.0)


def learning_rate(step: ColumnLike, first: float, last: float, steps: int, delay_steps: int = 0, delay_mult: float = 1.0) -> Column:
    """Log-linear from ``first`` to ``last``, eased in over ``delay_steps``; 0 before step 0."""
    import math

    s = col(step)
    t = clip(s / steps, 0.0, 1.0)
    rate = F.exp(math.log(first) * (1 - t) + math.log(last) * t)
    ease = F.lit(1.0)
    if delay_steps:
        ease = delay_mult + (1 - delay_mult) * F.sin(0.5 * math.pi * clip(s / delay_steps, 0.0, 1.0))
    return F.when(s < 0, F.lit(0.0)).otherwise(ease * rate)
