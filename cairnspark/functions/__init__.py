from cairnspark.functions.clf import (
    HOST_PATTERN,
    REQUEST_PATTERN,
    SIZE_PATTERN,
    STATUS_PATTERN,
    TIME_PATTERN,
    clf_time,
    file_name,
)
from cairnspark.functions.hashing import hash_bucket
from cairnspark.functions.weekdays import weekday_name, weekday_number

__all__ = [
    "HOST_PATTERN",
    "REQUEST_PATTERN",
    "SIZE_PATTERN",
    "STATUS_PATTERN",
    "TIME_PATTERN",
    "clf_time",
    "file_name",
    "hash_bucket",
    "weekday_name",
    "weekday_number",
]
