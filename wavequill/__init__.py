"""wavequill: multichannel signal analytics and training-data operators on Spark DataFrames."""
