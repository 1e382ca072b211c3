"""Per-token losses as expressions over an array of logits, and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def with_softmax(df: DataFrame, logits: str = "logits", label: str = "label", p: str = "p") -> DataFrame:
    """Adds p (probabilities), lse (log of the sum), p_label and ce of each row's label."""
    rows = df.withColumn("_m", F.array_max(logits)).withColumn("lse", F.log(total(F.transform(logits, lambda x: F.exp(x - F.col("_m"))))) + F.col("_m"))
    rows = rows.withColumn(p, F.transform(logits, lambda x: F.exp(x - F.col("lse")))).withColumn("ce", F.col("lse") - F.element_at(logits, F.col(label) + 1))
    return rows.withColumn("p_label", F.exp(-F.col("ce"))).drop("_m")


def entropy(p: Column) -> Column:
    return -total(F.transform(p, lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)))


def kl(base: Column, current: Column) -> Column:
    return total(F.zip_with(base, current, lambda b, c: F.when(b > 0, b * (F.log(b) - F.log(c))).otherwise(0.0)))


def deft_gate(p: Column, p_label: Column) -> Column:
    """p_label to the power of the sum of squared probabilities."""
    return F.pow(p_label, dot(p, p))


def dft(p_label: Column, ce: Column) -> Column:
    return p_label * ce


def infosft_weight(p_label: Column, target: float = 0.5) -> Column:
    """q * max(0, logit(target) - logit(q)) before it is normalised to mean 1."""
    q = F.least(F.greatest(p_label, F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = lambda x: F.log(x) - F.log1p(-x)
    return q * F.greatest(logit(F.lit(target)) - logit(q), F.lit(0.0))


def cadft(rows: DataFrame, sample: str, batch: str, beta: float = 1.0) -> DataFrame:
    """Per sample: the sum of p * ce, damped by exp(-beta * max(0, z)), z of its mean loss within the batch."""
    per = rows.groupBy(batch, sample).agg(F.avg("ce").alias("nll"), F.sum(dft(F.col("p_label"), F.col("ce"))).alias("dft"))
    w = Window.partitionBy(batch)
    z = (F.col("nll") - F.avg("nll").over(w)) / F.greatest(F.coalesce(F.stddev_samp("nll").over(w), F.lit(0.0)), F.lit(1e-6))
    return per.withColumn("weight", F.exp(-beta * F.greatest(z, F.lit(0.0)))).withColumn("loss", F.col("weight") * F.col("dft"))


def perplexity(loss: Column, cap: float = 20.0) -> Column:
    return F.exp(F.least(loss, F.lit(cap)))


def slerp(a: Column, b: Column, t: float) -> Column:
    """Spherical mean of two vectors; linear where they are nearly parallel or one is nearly zero."""
    cos = dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))
    omega = F.acos(F.least(F.greatest(cos, F.lit(-1.0)), F.lit(1.0)))
    line = F.zip_with(a, b, lambda x, y: x * (1 - t) + y * t)
    wa, wb = F.sin((1 - t) * omega) / F.sin(omega), F.sin(t * omega) / F.sin(omega)
    arc = F.zip_with(a, b, lambda x, y: x * wa + y * wb)
    return F.when((F.abs(cos) > 0.9999) | (norm(a) < 1e-8) | (norm(b) < 1e-8), line).otherwise(arc)


def unit(v: Column) -> Column:
    n = norm(v)
    return F.transform(v, lambda x: x / n)


#: Objectives by priority: the first whose flag is set is the run's.
OBJECTIVES = ("pre_rl", "deft", "cadft", "dft", "info_sft")


def objective(flags: dict[str, Column]) -> Column:
    """The name of the objective that a run uses, by its flags; plain cross-entropy without any."""
    return F.coalesce(*[F.when(flags[n], F.lit(n)) for n in OBJECTIVES if n in flags], F.lit("ce"))


def generalization_gap(train_loss: Column, val_loss: Column) -> Column:
    return val_loss - train_loss


def flat_cosine(a: Column, b: Column) -> Column:
    """Cosine of two tensors given as arrays of vectors, flattened; 0 where one is nearly zero."""
    x, y = F.flatten(a), F.flatten(b)
    size = norm(x) * norm(y)
    return F.when(size > 1e-12, dot(x, y) / size).otherwise(0.0)
