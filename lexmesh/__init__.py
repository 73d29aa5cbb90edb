"""lexmesh: string matching, record linkage and corpus preparation on Spark."""
