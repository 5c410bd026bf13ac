"""The registry of this subpackage's queries."""

from codeweft.registry import Registry

LLM = Registry()
