"""cardloom: trading-card catalogue and tournament analytics as Spark DataFrame operators.

Every operator is a function from DataFrames and parameters to a DataFrame. Nothing here starts an action except the
sinks and the jobs in ``cardloom.plans`` that write.
"""
