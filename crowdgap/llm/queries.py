"""Every query of this subpackage."""

from crowdgap.llm import (chat, codes, fingerprints, language, merkle, neardup, packing,  # noqa: F401
                          pieces, quality, simhash, suffixes, topk, urls)
from crowdgap.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
