"""Training-data operators: deduplication, decontamination, tokenization, filters.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
