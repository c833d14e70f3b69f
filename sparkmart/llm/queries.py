"""All registered queries of the package and the SQL they must agree with."""

from sparkmart.llm import chat, embeddings, exact_dedup, langid, line_dedup, mixing, near_dedup, pieces, prefix_trie, privacy, repeats, spelling, topk
from sparkmart.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "chat", "embeddings", "exact_dedup", "langid", "line_dedup", "mixing", "near_dedup", "pieces", "prefix_trie", "privacy", "repeats", "spelling", "topk"]
