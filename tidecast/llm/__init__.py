"""Operators for preparing training data at scale; each module holds one operator.

Functions that run inside Python workers are shipped by value, so executors need no copy of this
package on their path.
"""

import importlib
import pkgutil

from pyspark import cloudpickle


def ship_by_value() -> None:
    """Make Spark pickle this package's functions whole instead of by module name."""
    for m in pkgutil.iter_modules(__path__):
        cloudpickle.register_pickle_by_value(importlib.import_module(f"{__name__}.{m.name}"))
