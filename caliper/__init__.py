"""caliper — tabular enrichment and class-imbalanced outcome-model evaluation on Spark.

Every public operator takes DataFrames plus column names and returns a DataFrame.
Heavy work runs as Spark SQL / Spark ML plans; nothing is collected to the driver
except tiny, bounded tables (K classes, K² confusion cells, a threshold grid).
"""

__version__ = "0.1.0"
