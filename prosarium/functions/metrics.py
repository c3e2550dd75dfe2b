"""Evaluation metrics as aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mae(true: Column, pred: Column) -> Column:
    return F.avg(F.abs(true - pred))


def mse(true: Column, pred: Column) -> Column:
    return F.avg(F.pow(true - pred, F.lit(2)))


def rmse(true: Column, pred: Column) -> Column:
    return F.sqrt(mse(true, pred))


def r2(true: Column, pred: Column) -> Column:
    """1 - residual over total sum of squares of the pairs; null with less than two pairs or no variance. Not
    the squared correlation. One pass: the total comes from sums."""
    both = true.isNotNull() & pred.isNotNull()
    t = F.when(both, true)
    n, total = F.count(t), F.var_pop(t) * F.count(t)
    return F.when((n >= 2) & (total > 0), 1 - F.sum(F.when(both, F.pow(true - pred, F.lit(2)))) / total)


def ratio(a: Column, b: Column) -> Column:
    """0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(0.0)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def presence_scores(pred: Column, ref: Column) -> list[Column]:
    """Precision, recall, f1 of presence over rows, from two Boolean columns."""
    tp, fp, fn = (F.sum(c.cast("int")) for c in (pred & ref, pred & ~ref, ~pred & ref))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1")]


def perplexity(loss: Column) -> Column:
    """G18."""
    return F.exp(F.avg(loss))


def geometric_mean(c: Column) -> Column:
    """Over the values above 0."""
    return F.exp(F.avg(F.when(c > 0, F.ln(c))))


def safe_std(c: Column) -> Column:
    """Population deviation, 1 in place of 0."""
    s = F.stddev_pop(c)
    return F.when(s == 0, 1.0).otherwise(s)


def exact_median(c: Column) -> Column:
    return F.percentile(c, F.lit(0.5))
