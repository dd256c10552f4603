"""Query on license scans."""

from __future__ import annotations

from foldwise.llm.common import sf_table
from foldwise.llm.licenses import scan_licenses


def op10_license_scan(spark, sf_dir):
    return scan_licenses(sf_table(spark, sf_dir, "documents"))


QUERIES = {"op10_license_scan": op10_license_scan}
ORACLE: dict[str, str] = {}
