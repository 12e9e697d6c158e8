"""Training-data operators: ten independent Spark jobs and the corpus pipeline.

Nothing outside this subpackage imports it; ``__spark_entry__`` registers its
queries only when it can be imported.
"""
