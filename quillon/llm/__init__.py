"""Training-data operators: cleaning, deduplication, search and packing of text corpora.

Nothing outside this package imports it; ``quillon.llm.queries`` registers its queries.
"""
