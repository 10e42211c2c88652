"""All queries of this subpackage; importing the modules registers them."""

from tidemark.llm.common import QUERIES, SQL  # noqa: F401
from tidemark.llm import (  # noqa: F401
    decontaminate, exact_dedup, html_text, line_dedup, merkle, periodic, pieces, sharding, simhash, substring_dedup, toxicity, url_rules, warc,
)
