from marquee.sources.adapter import DriverTables, driver_tables
from marquee.sources.files import (
    profile, read_csv, read_movies_csv, read_parquet, read_ratings_csv,
    read_tags_csv, write_csv, write_parquet,
)

__all__ = [
    "DriverTables", "driver_tables", "profile", "read_csv", "read_movies_csv",
    "read_parquet", "read_ratings_csv", "read_tags_csv", "write_csv", "write_parquet",
]
