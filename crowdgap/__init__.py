"""crowdgap: expert-versus-crowd disagreement analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors do not need the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
