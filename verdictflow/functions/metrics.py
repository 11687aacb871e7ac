"""Classification metrics as column expressions over counters; a zero denominator gives 0.0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def ratio(part: Column | str, whole: Column | str) -> Column:
    return F.coalesce(F.try_divide(_col(part), _col(whole)), F.lit(0.0))


def precision(tp, fp) -> Column:
    return ratio(tp, _col(tp) + _col(fp))


def recall(tp, fn) -> Column:
    return ratio(tp, _col(tp) + _col(fn))


def f1(tp, fp, fn) -> Column:
    p, r = precision(tp, fp), recall(tp, fn)
    return ratio(2.0 * p * r, p + r)


def f_beta(beta: float, tp, fp, fn) -> Column:
    """F score in which recall counts beta^2 times as much as precision."""
    b = float(beta) ** 2
    return ratio((1 + b) * _col(tp), (1 + b) * _col(tp) + b * _col(fn) + _col(fp))


def accuracy(tp, fp, fn, tn) -> Column:
    return ratio(_col(tp) + _col(tn), _col(tp) + _col(fp) + _col(fn) + _col(tn))


def mcc(tp, fp, fn, tn) -> Column:
    """Matthews correlation. Counters are doubles before they are multiplied: the product of four overflows longs."""
    t, p, n, m = _col(tp), _col(fp), _col(fn), _col(tn)
    return ratio(t * m - p * n, F.sqrt((t + p) * (t + n) * (m + p) * (m + n)))


def hallucination_rate(hallucinations, bug_tp, bug_fp, ghosts) -> Column:
    return ratio(hallucinations, _col(bug_tp) + _col(bug_fp) - _col(ghosts))


def confirmation_rate(confirmed, not_confirmed, inconclusive) -> Column:
    return ratio(confirmed, _col(confirmed) + _col(not_confirmed) + _col(inconclusive))


def noise_reduction(bug_fp, hybrid_fp) -> Column:
    return ratio(_col(bug_fp) - _col(hybrid_fp), bug_fp)
