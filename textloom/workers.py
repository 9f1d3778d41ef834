"""Where Python workers find this package."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import DataFrame

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reachable(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``f(spark, ...)``, with the package's folder on the path of the session's Python workers, wherever the driver was started."""

    @functools.wraps(f)
    def run(spark, *args):
        known = spark.sparkContext.environment.get("PYTHONPATH", "")
        if HERE not in known.split(os.pathsep):
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (HERE, known) if x)
        return f(spark, *args)

    return run
