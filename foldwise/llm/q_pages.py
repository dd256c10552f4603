"""Queries on raw pages."""

from __future__ import annotations

from foldwise.llm.common import sf_table
from foldwise.llm.style_tree import extract
from foldwise.llm.warc import read_archives, write_archives


def op3_html_extraction(spark, sf_dir):
    return extract(sf_table(spark, sf_dir, "pages"))


def op7_warc(spark, sf_dir):
    pages = sf_table(spark, sf_dir, "pages")
    return read_archives(write_archives(pages), pages.schema["page_id"].dataType).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


QUERIES = {"op3_html_extraction": op3_html_extraction, "op7_warc": op7_warc}
ORACLE: dict[str, str] = {}
