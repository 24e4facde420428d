"""pointloom: a Spark-native engine for clustering benchmarks and the data around them.

Every operator takes DataFrames and returns DataFrames; plans are declared with the
DataFrame API and left to Catalyst. Python runs only in Arrow batches, where the
built-in operators cannot express the semantics.
"""

__version__ = "0.1.0"
