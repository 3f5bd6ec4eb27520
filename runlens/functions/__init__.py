"""Column -> Column functions built only from Spark's built-in expressions."""

from runlens.functions.metrics import (  # noqa: F401
    py_round, np_round, composite_score, coefficient_of_variation,
)
