"""Column-expression helpers (JVM-side, codegen-friendly)."""

from tabulon.functions.text import (
    py_strip, py_tokens, blank_to_empty, slug, ordered_ci_union, nonblank,
)
from tabulon.functions.numeric import (
    lenient_double, finite_or_null, js_round, safe_pearson, safe_pct_change, round_half_up,
    mean, exact_sum,
)

__all__ = [
    "py_strip", "py_tokens", "blank_to_empty", "slug", "ordered_ci_union", "nonblank",
    "lenient_double", "finite_or_null", "js_round", "safe_pearson", "safe_pct_change",
    "round_half_up", "mean", "exact_sum",
]
