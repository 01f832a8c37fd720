"""Spark-native text analytics: Markdown corpora, chunks, links, terms, hybrid retrieval, quality reports."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
