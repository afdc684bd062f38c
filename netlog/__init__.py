"""Network log analytics over captured traffic, as DataFrame functions."""

import sys

from pyspark import cloudpickle

from .operators import *  # noqa: F401,F403
from .operators import __all__ as _operators
from .session import as_table, configure, ensure_checkpoint_dir

__all__ = [*_operators, "as_table", "configure", "ensure_checkpoint_dir"]

# Python tasks carry their few functions with them, so the package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
