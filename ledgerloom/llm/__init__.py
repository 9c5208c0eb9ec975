"""Ten operators for large training corpora, each over DataFrames of the ``documents`` or ``embeddings`` shape.

Nothing else in the library imports this package; its queries are in ``ledgerloom.llm.queries``.
"""
