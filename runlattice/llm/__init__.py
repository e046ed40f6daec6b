"""Operators for building language-model training data on Spark.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries only when it is present.
"""
