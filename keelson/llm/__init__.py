"""Training-data operators: whole-text, skew-safe, restartable Spark jobs.

Nothing outside this subpackage imports it.  Modules whose functions run inside
Python workers are pickled by value, so executors need numpy and pyarrow but no
copy of this package.
"""
