"""Column expressions shared by the operators (null, zero and text rules)."""

from tillroll.functions.exprs import (  # noqa: F401
    currency,
    id_text,
    matches_any,
    n_unique,
    ratio,
    thousands,
    zero_sum,
)
