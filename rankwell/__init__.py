"""rankwell: curate labelled corpora and judge ordinal predictors with Spark.

Every operator takes and returns DataFrames.  The sub-packages are

* ``sources``    readers, writers and ingest joins,
* ``functions``  Column expressions and the skew-safe building blocks,
* ``operators``  the DataFrame operators,
* ``streaming``  the request stream,
* ``plans``      whole jobs, and the catalogue behind ``__spark_entry__``.
"""

__version__ = "0.1.0"
