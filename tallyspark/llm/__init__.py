"""Operators for preparing training corpora at scale. Nothing outside this subpackage imports it."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run on executors travel with their code, so executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])
