"""Event-driven research on price bars, written as Spark jobs."""

import sys

from pyspark import cloudpickle

from sparkbars.session import build_session, cut, prepare

# Functions that run inside tasks travel whole, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "cut", "prepare"]
