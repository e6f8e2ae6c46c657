"""Column functions for web-server access-log lines (Common Log Format)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# These patterns define the parsed fields. Two are written for time linear in the line:
# they find the same groups as the plain forms ``(^\S+\.[\S+\.]+\S+)\s`` and ``\"(\S+)\s(\S+)\s*(\S*)\"``,
# which take cubic and quadratic time on long broken lines (tests compare them).
# Host: inside the brackets ``\S`` is all there is, so two more characters must follow a dot.
HOST_PATTERN = r"^(?=\S++\s)(\S+\.\S{2,})\s"
TIME_PATTERN = r"\[(\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2} -\d{4})]"
# With ``+`` zones too; the plain pattern leaves their time out.
ANY_ZONE_TIME_PATTERN = r"\[(\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4})]"
# Request, in two tiers. A well-formed line matches at its first quote, to which the first branch leads at once.
# Where that fails, the second branch tries the words one by one: if the first quote of a word begins no match,
# no later quote of that word does. The second group is the whole word if the word after it has a quote, else
# what stands before its own last quote.
REQUEST_PATTERN = r"(?:^[^\"]*|(?<!\S)[^\s\"]*+)\"(\S+)\s(\S+(?=\s+\S*\"|\"))\s*(\S*)\""
STATUS_PATTERN = r"\s(\d{3})\s"
SIZE_PATTERN = r"\s(\d+)$"

# The patterns of the alternative five-field reading.
SPLIT_HOST_PATTERN = r"^(.*) - -.*"
# ``.* - - \[(.*)\].*`` in two steps of linear time: up to the last bracket, then from the last mark on.
SPLIT_TIME_END_PATTERN = r"(?m)^(.*)\]"
SPLIT_TIME_PATTERN = r"(?m)^.* - - \[(.*)$"
# ``.*\"(.*)\".*`` tried at the start of the line only: a first run of any characters covers the rest.
SPLIT_REQUEST_PATTERN = r"(?m)^.*\"(.*)\".*"


def clf_time(col: str | Column, honour_zone: bool = False) -> Column:
    """``dd/Mon/yyyy:HH:MM:SS zone`` as a timestamp; NULL where the text is not such a time.

    By default the zone is ignored and the wall-clock reading is kept. With ``honour_zone`` the
    result is the instant that the zone denotes.
    """
    text = F.col(col) if isinstance(col, str) else col
    if honour_zone:
        return F.try_to_timestamp(text, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    return F.try_to_timestamp(F.substring(text, 1, 20), F.lit("dd/MMM/yyyy:HH:mm:ss"))


def file_name(col: str | Column) -> Column:
    """The part of a path after its last slash; empty when the path ends in one."""
    return F.regexp_extract(col, r"([^/]+)$", 1)
