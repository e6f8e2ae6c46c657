from cairnspark.sources.readers import (
    RATINGS,
    TAG_NAMES,
    TAG_SCORES,
    Checked,
    read_checked,
    read_log,
    read_ratings,
    read_tag_scores,
    read_tags,
    read_wide,
    wide_schema,
)
from cairnspark.sources.tables import fresh_path, materialise, release, scratch, write_parquet

__all__ = [
    "RATINGS",
    "TAG_NAMES",
    "TAG_SCORES",
    "Checked",
    "fresh_path",
    "materialise",
    "read_checked",
    "read_log",
    "read_ratings",
    "read_tag_scores",
    "read_tags",
    "read_wide",
    "release",
    "scratch",
    "wide_schema",
    "write_parquet",
]
