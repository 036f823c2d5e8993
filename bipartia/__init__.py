"""bipartia: association analytics and training-data preparation on Spark."""
