"""postlens — content-engagement analytics as Spark DataFrame operators.

Every operator takes a DataFrame plus column names / parameters as keywords
and returns a lazily built DataFrame.  Nothing is collected to the driver
except tiny, size-bounded aggregates (quantile rows, ranked top-k lists).
"""

from postlens.session import get_session, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
