"""All queries of the interval, vector and signal operators; importing them registers them."""

from . import queries_intervals  # noqa: F401
from . import queries_vectors  # noqa: F401
from . import queries_signal  # noqa: F401
from . import queries_sources  # noqa: F401
