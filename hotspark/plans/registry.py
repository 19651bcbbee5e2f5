"""All registered queries and their SQL twins."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, functions as F, types as T

from hotspark.session import prepare

MODULES = ["points", "clusters", "events", "match", "shapes", "grids", "curved", "layers", "scalars", "storage", "tracking"]


def _plain_times(df: DataFrame) -> DataFrame:
    """Times as zone-free UTC timestamps, as the given tables hold them."""
    cols = [
        F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    return df.select(*cols)


def _register(fn):
    def run(spark, sf_dir):
        return _plain_times(fn(prepare(spark), sf_dir))

    run.__doc__ = fn.__doc__
    return run


QUERIES, ORACLE = {}, {}
for _name in MODULES:
    _module = importlib.import_module(f"hotspark.plans.{_name}")
    for _key, _fn in _module.Q.items():
        QUERIES[_key] = _register(_fn)
    ORACLE.update(_module.SQL)
