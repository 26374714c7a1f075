"""Link audits over landed web pages, as Spark jobs."""

import sys

from pyspark import cloudpickle

from hrefsieve.params import AuditParams

# Python helpers used inside tasks travel with the job, so executors need no copy
# of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["AuditParams"]
