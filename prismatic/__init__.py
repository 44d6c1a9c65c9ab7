"""Prismatic: spectral analytics and corpus preparation on PySpark DataFrames."""

import pickle
import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class ByValue:
    """For broadcasts of objects of this package's classes: Spark pickles what it broadcasts by reference, which would need a copy on executors. Their `.value` is `held`."""

    def __init__(self, held):
        self.held = held

    def __reduce__(self):
        return pickle.loads, (cloudpickle.dumps(self.held),)
