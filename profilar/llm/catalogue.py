"""Registered queries of the training-data operators and, where SQL can say the same, their SQL."""

from profilar.llm import queries  # noqa: F401
from profilar.llm.registry import QUERIES, SQL  # noqa: F401
