"""Make this package's Python jobs run where the package is not installed."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship() -> None:
    """Send the package's functions and classes with each job instead of by name.

    Covers executors and the worker that plans stateful streams. Not needed where
    the package is installed on all machines or passed with ``--py-files``.
    """
    cloudpickle.register_pickle_by_value(sys.modules["pagewatch"])
