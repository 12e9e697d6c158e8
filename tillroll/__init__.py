"""tillroll: retail basket analytics as plain Spark DataFrame functions.

Every public function takes DataFrames (or a SparkSession plus paths) and
returns a lazy DataFrame; nothing is collected inside the library. The
``plans`` package composes the operators into the dashboard pages and the
registered queries.
"""

__version__ = "0.1.0"
