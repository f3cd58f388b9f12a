"""Training-data operators: deduplication, classification, secrets, packing, tokenising, search.

Nothing outside this subpackage imports it. Its functions run inside Spark's Python workers,
so they are shipped with the job by value: workers need no copy of the package.

Common rules, unless an operator states otherwise: a null text counts as an empty one, a null
id is carried through, repeated rows each get their own result, columns other than those an
operator names are ignored, and an empty table gives an empty result.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
