"""docweave: filter, search, rank and maintain collections of documents with Spark DataFrames."""
