"""The answer bundle (S7): small marts written once per input version, which reports read instead of the fact.

The version is the signature of all input files of the role views, so new rows in any table make a new bundle.  The
pointer is published after the last mart: a bundle is whole or not there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..plans import inventory as inv
from ..plans import overview as ov
from ..plans import patterns as pa
from ..plans import trend as tr
from ..sources import star
from ..sources.roles import Roles
from ..sources.sinks import bundle_dir, write_bundle

MARTS: dict[str, Callable[[Roles], DataFrame]] = {
    "store_summary": ov.store_summary,
    "ranked_categories": tr.ranked_categories,
    "peak_hours": pa.peak_hours_all,
    "best_days": pa.best_days_all,
    "monthly_revenue": tr.monthly_revenue_all,
    "slow_moving": inv.slow_moving,
}


def published_bundle(roles: Roles) -> str:
    """Folder of the bundle of the views' input version, written if there is none."""
    spark = roles.stores.sparkSession
    pointer = bundle_dir(roles, roles.signature) + ".current"
    base = star.published(spark, pointer)
    if base is None:
        base = f"{bundle_dir(roles, roles.signature)}-{uuid.uuid4().hex}"
        write_bundle({name: build(roles) for name, build in MARTS.items()}, base)
        base = star.publish(spark, pointer, base)
    return base


def answers(roles: Roles) -> dict[str, DataFrame]:
    """The marts by name, read from the bundle; views without a signature (a live database) plan them anew."""
    if roles.signature is None:
        return {name: build(roles) for name, build in MARTS.items()}
    base, spark = published_bundle(roles), roles.stores.sparkSession
    return {name: spark.read.parquet(f"{base}/{name}") for name in MARTS}
