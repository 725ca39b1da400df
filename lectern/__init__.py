"""Course-content analytics and corpus operators on Spark DataFrames."""
