"""Links to evidence and paths of files, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Owners and names that only stand for others, and directories of copied dependencies.
PLACEHOLDER_OWNERS = "example example-org example-user external-org mirror-labs test-org test-user dummy placeholder localhost".split()
PLACEHOLDER = r"(?i)/(?:example|dummy|placeholder|test|fixture|corpus-copy|duplicate-bug)(?:[-_/]|$)"
VENDOR_MARKERS = "vendor vendors third_party thirdparty 3rdparty external externals deps dependencies submodules contrib vendored".split()


def gate(url: Column, kind: Column, status: Column, host: str) -> Column:
    """Why a link may not be shown as evidence, or 'eligible'; the first reason counts. Nothing is fetched."""
    u = F.trim(F.coalesce(url, F.lit("")))
    part = lambda pattern: F.regexp_extract(u, pattern, 1)
    owner, name = part(r"^https://[^/?#]+/+([^/?#]+)"), part(r"^https://[^/?#]+/+[^/?#]+/+([^/?#]+)")
    k, s = F.lower(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(status, F.lit("")))
    evidence = k.contains("code_search") | k.contains("issue_search") | k.contains("source_pr") | s.contains("exact") | s.contains("issue")
    return (
        F.when(u == "", "missing_url")
        .when(F.lower(part(r"^https://([^/?#]+)/+[^/?#]")) != host, "foreign_host")
        .when(F.lower(owner).isin(PLACEHOLDER_OWNERS) | F.concat(F.lit("/"), owner, F.lit("/"), name, F.lit("/")).rlike(PLACEHOLDER), "placeholder")
        .when(~evidence, "not_evidence")
        .otherwise("eligible")
    )


def vendor_like(path: Column, repo: Column) -> Column:
    """Whether a directory of the path holds copied dependencies or bears the name of the repository."""
    parts = F.split(F.lower(F.translate(path, "\\", "/")), "/")
    return F.arrays_overlap(parts, F.array(*[F.lit(m) for m in VENDOR_MARKERS])) | F.array_contains(parts, F.element_at(F.split(repo, "/"), -1))


def percent_encoded(x: Column) -> Column:
    """All but letters, digits and - . _ ~ as bytes in percent form."""
    return F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
