"""Road-network fragmentation analytics and training-data operators on Spark."""
