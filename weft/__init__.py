"""A PySpark engine for a document knowledge base: search, graph, retrieval, evaluation, storage and streams."""
