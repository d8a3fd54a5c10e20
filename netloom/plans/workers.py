"""What workers of Python functions need."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(module: str) -> None:
    """Sends the functions of ``module`` to workers by value: executors need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
