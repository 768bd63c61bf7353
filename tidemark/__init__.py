"""Lakehouse tables, predicate search and vector search as plain Spark jobs."""

from pyspark import cloudpickle as _cloudpickle

import tidemark as _package

# Functions sent to executors carry their code along, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_package)
