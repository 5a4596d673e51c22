"""The site of a url: its host in lower case without a leading ``www.``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Possessive, and nothing before "//": no text is searched twice, however long it is.
_AFTER_SLASHES = r"//(?:[^/?#\s@]*+@)?([^/?#\s:)>\]\"'\\]++)"
_BARE = r"^[\s \"'<(\[]*+([^/?#\s:)>\]\"'\\ ]+\.[^/?#\s:)>\]\"'\\ ]+)"


def site_of(url: Column) -> Column:
    """NULL for a null or empty url, or one without a host; brackets, quotes and link labels around it don't matter."""
    found = F.regexp_extract(url, _AFTER_SLASHES, 1)
    host = F.lower(F.when(found != "", found).otherwise(F.regexp_extract(url, _BARE, 1)))
    host = F.regexp_replace(F.rtrim(F.regexp_replace(host, r"(?<![.,;])[.,;]++$", "")), r"^www\.", "")
    return F.when(host != "", host)
