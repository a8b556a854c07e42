"""What all operators do with a mask, an accumulator and the object they write to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.algebra import BinaryOp
from lattica.operators.objects import Descriptor, Matrix, Vector


def masked(df: DataFrame, mask: Vector | Matrix | None, keys: tuple[str, ...], desc: Descriptor) -> DataFrame:
    """The rows whose key the mask lets through: true entries, or with complement all others."""
    if mask is None:
        return df
    return df.join(mask.true_indices(), list(keys), "left_anti" if desc.complement else "left_semi")


def write(t: DataFrame, keys: tuple[str, ...], old: DataFrame | None, mask, accum: BinaryOp | None, desc: Descriptor) -> DataFrame:
    """t already holds only what the mask lets through.

    Without accum t takes the place of what the mask lets through, and old entries outside the mask stay. With
    accum old entries that t lacks stay too, and where both have one, accum(old, new) is
    stored. replace drops old entries outside the mask.
    """
    if old is None or (accum is None and (mask is None or desc.replace)):
        return t
    if accum is None:
        return masked(old.select(*keys, "v"), mask, keys, desc.toggle("complement")).unionByName(t.select(*keys, "v"))
    if desc.replace:
        old = masked(old, mask, keys, desc)
    both = old.select(*keys, F.col("v").alias("_old")).join(t.select(*keys, F.col("v").alias("_new")), list(keys), "full_outer")
    v = F.when(F.col("_old").isNull(), F.col("_new")).when(F.col("_new").isNull(), F.col("_old")).otherwise(accum(F.col("_old"), F.col("_new")))
    return both.select(*keys, v.alias("v"))
