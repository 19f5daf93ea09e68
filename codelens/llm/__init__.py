"""Operations of a large-scale training-data pipeline, as Spark jobs.

Nothing outside this subpackage imports it.  ``queries.py`` registers one
query per operator; ``/corpus_pipeline.py`` chains five of them.
"""
