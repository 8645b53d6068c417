"""Operations of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage; ``__spark_entry__.py``
adds its queries (``corvane.llm.queries``) when it can be imported.
"""
