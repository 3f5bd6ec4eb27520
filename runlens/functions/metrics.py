"""Score arithmetic: rounding, composite score, coefficient of variation.

Two rounding rules occur in the reports and they differ at ties:

* ``py_round`` -- Python's ``round(x, k)``: half-to-even on the *exact*
  binary value of ``x``.  ``x * 10**k`` is formed with an error-free
  product (Dekker's split), so a product that only *looks* like a tie
  after floating rounding is resolved by the sign of the lost error.
* ``np_round`` -- pandas/numpy ``round``: ``rint(x * 10**k) / 10**k``.

Both are plain arithmetic over built-in expressions, so they stay inside
whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.schemas import DIM_COLS, DIM_WEIGHTS

_SPLIT = 134217729.0  # 2**27 + 1, Dekker's splitter for doubles


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_round(c, digits: int = 0) -> Column:
    """Python ``round(c, digits)`` (half-even on the exact double value).

    ``digits`` must be 0..6 so that ``10**digits`` splits exactly.
    With ``digits == 0`` the result is still a double; cast it for ``round(x)``.
    """
    if not 0 <= digits <= 6:
        raise ValueError("digits must be in 0..6")
    x = _col(c)
    t = float(10 ** digits)
    p = x * t
    xs = x * _SPLIT
    hi = xs - (xs - x)
    err = (hi * t - p) + (x - hi) * t    # exact: x*t == p + err
    f = F.floor(p).cast("double")
    # Off a tie rint is exact; on a tie of the rounded product the sign of
    # the lost error decides, and an exact tie goes to even (rint).
    tie = F.when(err > 0.0, f + 1.0).when(err < 0.0, f).otherwise(F.rint(p))
    return F.when(p - f == 0.5, tie).otherwise(F.rint(p)) / t


def np_round(c, digits: int = 0) -> Column:
    """pandas/numpy ``round``: ``rint(c * 10**digits) / 10**digits``."""
    t = float(10 ** digits)
    return F.rint(_col(c) * t) / t


def composite_score(prefix: str = "", weights: dict | None = None) -> Column:
    """Weighted sum of the six dimensions, added in dimension order."""
    w = weights or DIM_WEIGHTS
    acc = None
    for d in DIM_COLS:
        term = F.col(prefix + d) * float(w[d])
        acc = term if acc is None else acc + term
    return acc


def coefficient_of_variation(std: Column, mean: Column, guard: Column | None = None) -> Column:
    """``std / mean * 100``; 0 when the guard (default ``mean > 0``) fails."""
    g = guard if guard is not None else (mean > 0.0)
    return F.when(g, std / mean * 100.0).otherwise(F.lit(0.0))


def consistency_from_moments(n: Column, means: list[Column], pop_stds: list[Column]) -> Column:
    """Consistency score of a group from per-dimension mean and population std.

    Per dimension ``cv = pop_std / mean * 100`` (0 when the mean is not
    positive), score ``100 - min(cv, 100)``; the group score is the plain mean
    over dimensions, and 100 for groups of fewer than two runs.
    """
    acc = None
    for m, s in zip(means, pop_stds):
        cv = coefficient_of_variation(s, m)
        term = F.lit(100.0) - F.least(cv, F.lit(100.0))
        acc = term if acc is None else acc + term
    return F.when(n < 2, F.lit(100.0)).otherwise(acc / float(len(means)))
