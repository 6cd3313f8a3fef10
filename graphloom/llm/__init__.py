"""Training-data operators for large text, vector and URL tables.

Nothing outside this folder imports it; deleting it (with ``corpus_pipeline.py``)
leaves the rest of the library whole.
"""
