"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  `entries.queries()` and
`entries.oracle_sql()` list its queries.
"""

import panelforge
from pyspark import cloudpickle

# Functions travel to the executors by value: a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(panelforge)
