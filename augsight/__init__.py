"""augsight — labelled-document corpus analytics on Spark.

Every operator is a plain DataFrame -> DataFrame transformation (or a
small composition of them) so Catalyst sees one lazy plan per job.
Sub-packages:

* ``sources``   — reading the driver tables into the canonical corpus,
                  literal-column decoding, score directories, writers.
* ``functions`` — Column-expression builders (hash keys, text, arrays).
* ``operators`` — relational operators (ranks, imbalance, dedup, splits,
                  augmentation, features, metrics, ROUGE, training-set shaping).
* ``plans``     — composite jobs and the query catalog used by
                  ``__spark_entry__``.
* ``streaming`` — intentionally empty: the workload has no streams.
"""

__version__ = "0.1.0"
