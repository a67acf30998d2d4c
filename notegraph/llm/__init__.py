"""Operators for preparing language-model training text at scale.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when it is present.
"""

from notegraph.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
