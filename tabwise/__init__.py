"""tabwise: profile, clean, chart-data and regression-model operators on Spark DataFrames."""
