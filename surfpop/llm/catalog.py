"""The corpus queries and their SQL, gathered from the operators' modules."""

from surfpop.llm import chat, collocation, decontaminate, exact_dedup, html_text, jaccard_join, line_dedup, packing, quality, spelling, suffix_dedup, toxicity, warc  # noqa: F401
from surfpop.llm.common import QUERIES, SQL  # noqa: F401
