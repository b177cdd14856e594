"""Retrieval, grounding, profiling, evaluation, statistics and benchmark-construction operators."""
