"""rulesift: label auditing and edge-case rule discovery as Spark DataFrame jobs.

Every public function takes and returns DataFrames; the work runs in Spark SQL
expressions, joins, aggregates, windows and Spark ML. Python runs only inside
the three pluggable functions (annotator, embedder, synthesizer) via
``mapInPandas`` and in the leaf step of balanced clustering.
"""

__version__ = "0.1.0"
