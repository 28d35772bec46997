"""marquee: a PySpark-native movie recommendation analytics library.

Every operator is a function from DataFrames to DataFrames. Nothing here
creates a session at import time, reads a hard-coded path or collects data
to the driver; the caller passes tables in and gets a lazy plan back.
"""

from marquee.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
