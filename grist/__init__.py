"""grist: ranked text retrieval and text processing on Spark DataFrames."""
