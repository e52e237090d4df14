"""Operators for preparing training text: scoring, filtering, near-duplicate
detection, search, tokenisation and packing.

Each module holds one operator with its own interface.  ``queries`` binds the
registered ``opN_<name>`` queries to the tables of a folder.  Nothing outside
this package (besides ``corpus_pipeline.py``) imports it.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that a
# cluster needs no copy of the repository on its Python path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
