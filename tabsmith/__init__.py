"""tabsmith: Spark-native profiling, cleaning, feature, modelling and audit operators.

Every operator takes and returns DataFrames. Fit steps collect only small,
bounded statistics (O(columns x levels)); transforms are lazy projections.
"""

__version__ = "0.1.0"
