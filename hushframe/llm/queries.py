"""All queries of the subpackage: importing this module registers them."""

from hushframe.llm import alignment, archives, exact_dedup, hard_negatives, html_text, minhash, mixing, packing, simhash, spotsigs, substring_dedup, suffix_dedup, toxicity  # noqa: F401
from hushframe.llm.catalog import ORACLES, QUERIES  # noqa: F401
