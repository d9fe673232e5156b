"""Operators of a training-data pipeline over the ``documents`` and ``embeddings`` tables.

One module per operator, ``queries.py`` registers them.  Nothing outside this
folder (and ``corpus_pipeline.py``) imports it.
"""
