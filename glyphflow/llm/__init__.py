"""Operators for preparing large text corpora: sharding, deduplication, filtering, extraction.

Nothing else in the package imports this subpackage; ``queries`` registers its
contract queries, and ``corpus_pipeline.py`` at the repository top chains five of
its operators.
"""
