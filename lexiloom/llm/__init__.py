"""Training-data operators: filtering, deduplication, search, encoding and packing.

Nothing outside this subpackage imports it; it can be deleted with
``tests/llm`` and ``corpus_pipeline.py`` and the library keeps working.
"""
