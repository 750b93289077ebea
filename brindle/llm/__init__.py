"""Training-data operators: filters, extraction, deduplication, formatting and packing.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds its queries
(:mod:`brindle.llm.queries`) only when it is present.
"""
