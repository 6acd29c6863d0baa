"""Text of the strongest feature attributions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-9


def top_features(values: Column, names: list[str], top_k: int = 3) -> Column:
    """`` | Top features: name (+0.30), ...`` or ``''``.

    The ``top_k`` entries of largest magnitude are taken first, then missing
    and tiny ones are left out. Equal magnitudes keep feature order, NaN sorts
    last. A value array of another length than ``names`` gives ``''``.
    """
    if not names:
        return F.lit("")
    labels = F.array(*[F.lit(n) for n in names])
    pairs = F.zip_with(
        values,
        F.arrays_zip(labels.alias("name"), F.sequence(F.lit(0), F.lit(len(names) - 1)).alias("pos")),
        lambda v, f: F.struct(
            F.coalesce(-F.abs(F.nanvl(v.cast("double"), F.lit(None).cast("double"))), F.lit(1.0)).alias("key"),
            f["pos"].alias("pos"),
            f["name"].alias("name"),
            v.cast("double").alias("value"),
        ),
    )
    strongest = F.slice(F.array_sort(pairs), 1, top_k)
    kept = F.filter(strongest, lambda s: (s["key"] <= -TINY))
    parts = F.transform(kept, lambda s: F.format_string("%s (%+.2f)", s["name"], s["value"]))
    usable = F.coalesce(F.size(values) == len(names), F.lit(False))
    return F.when(
        usable & (F.size(kept) > 0),
        F.concat(F.lit(" | Top features: "), F.array_join(parts, ", ")),
    ).otherwise(F.lit(""))
