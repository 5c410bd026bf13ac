"""All queries of the subpackage: importing this module registers them."""

import importlib

from codeweft.llm.registry import LLM

for _name in ("handwritten", "neighbours", "docpairs", "neardup", "splitting", "tokens", "mixing", "mojibake"):
    if importlib.util.find_spec(f"codeweft.llm.{_name}_queries") is not None:
        importlib.import_module(f"codeweft.llm.{_name}_queries")

__all__ = ["LLM"]
