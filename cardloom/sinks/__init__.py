"""Writers. Each starts one Spark job and writes from the executors."""
