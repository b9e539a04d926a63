"""Operators of a training-data pipeline: language identification, url rules, decontamination, tokenization, deduplication, quality,
search and extraction. Nothing else in the library imports this subpackage."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])  # functions go to the Python workers whole; executors need no copy of the package
