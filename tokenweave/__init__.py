"""Token-corpus preparation as PySpark DataFrame jobs.

Text corpora in, training-ready token data out: documents are split, tokenized,
laid out as one ordered token stream per split, packed into fixed-length
next-token sequences, permuted, batched and scheduled.  Every step is a plain
function from DataFrame to DataFrame.
"""

import sys

from pyspark import cloudpickle

# Python UDFs and the shard data source travel to the executors by value, so a
# cluster needs no copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
