"""vetta: Spark-native evaluation, blending and analysis of quality scores.

A segment table holds one row per (source item, system output, human score)
plus any number of predicted-score columns ("signals").  Every operator is a
function ``DataFrame -> DataFrame`` so the whole pipeline stays lazy and is
planned by Catalyst; only tiny results (edges, weights, partition totals) are
ever pulled to the driver.
"""

import sys

from pyspark import cloudpickle as _cloudpickle

# Ship this package's functions by value inside the UDF closures, so Python
# workers never need the package installed or on their path.
_cloudpickle.register_pickle_by_value(sys.modules[__name__])

from vetta.session import get_session  # noqa: E402,F401
