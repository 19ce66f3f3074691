"""Operators for preparing training data: each module holds one operator, `registered` lists them.

Nothing else in the library imports this subpackage, so it can be removed as a whole.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def queries() -> dict:
    from . import registered as q

    return dict(q.QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import registered as q

    return dict(q.ORACLES)
