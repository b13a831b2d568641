"""Text-and-lexicon analytics on Spark DataFrames.

Functions of this package that run inside tasks travel with the job by value, so executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
