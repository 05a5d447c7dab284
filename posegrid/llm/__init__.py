"""Training-data operators: one module per operator, its query beside it.

``queries.py`` gathers the registered queries; nothing outside this package
imports it except ``__spark_entry__`` (guarded) and ``corpus_pipeline``.
"""
