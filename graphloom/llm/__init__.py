"""Training-data operators (search, deduplication, mixing, scoring, packing).

Nothing outside this folder (and corpus_pipeline.py) imports it.
"""
