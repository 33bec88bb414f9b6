"""Training-data operators: filtering, tagging, tokenising and deduplicating a text corpus.

``queries()`` and ``oracle_sql()`` list what ``__spark_entry__`` registers.
"""
