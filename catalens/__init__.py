"""Catalogue matching and engagement analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from catalens.session import build_session  # noqa: E402

__all__ = ["build_session"]
