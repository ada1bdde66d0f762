"""Every registered query and, where SQL can say it, its oracle."""

from __future__ import annotations

import functools
import importlib

from opsframe.catalog.views import with_views
from opsframe.session import ship_package

MODULES = ["events", "workflow", "compute", "control", "text", "ledger", "streams", "flows"]


def _shipped(query):
    """Make sure the workers know this package before a query needs it there, in UTC."""

    @functools.wraps(query)
    def run(spark, sf_dir):
        ship_package(spark)
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # the oracles' clock
        return query(spark, sf_dir)

    return run


def all_queries():
    out = {}
    for name in MODULES:
        out.update(importlib.import_module(f"opsframe.catalog.{name}").QUERIES)
    return {k: _shipped(q) for k, q in out.items()}


def all_oracles():
    out = {}
    for name in MODULES:
        out.update(importlib.import_module(f"opsframe.catalog.{name}").ORACLES)
    return {k: with_views(v) for k, v in out.items()}
