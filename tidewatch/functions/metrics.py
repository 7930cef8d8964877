"""Choice between the documented and the legacy form of a metric."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolve_metric(doc: Column, legacy: Column, doc_key: str, legacy_key: str, source: str = "auto", flip_doc: bool = False) -> Column:
    """struct(value, used_key, used_source): the documented metric, the legacy one, or (auto) the first that is finite."""
    finite = lambda x: F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)
    a, b = finite(-doc if flip_doc else doc), finite(legacy)
    pick = lambda x, key, kind: F.struct(x.alias("value"), F.lit(key).alias("used_key"), F.lit(kind).alias("used_source"))
    if source == "doc":
        return pick(a, doc_key, "doc")
    if source == "legacy":
        return pick(b, legacy_key, "legacy")
    return F.when(a.isNotNull(), pick(a, doc_key, "doc")).otherwise(pick(b, legacy_key, "legacy"))
