"""Repository names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_repo(repo: Column | str) -> Column:
    """``owner/name`` in lower case, without surrounding blanks and tabs, scheme and host, and a final ``.git``.

    Null stays null; a blank name gives an empty string.
    """
    x = F.regexp_replace(F.lower(repo), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    x = F.regexp_replace(x, r"^[a-z][a-z0-9+.-]*://[^/]*/", "")
    return F.regexp_replace(F.regexp_replace(x, r"/+$", ""), r"\.git$", "")
