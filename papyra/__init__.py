"""papyra: document collections, retrieval and knowledge graphs as Spark DataFrames."""
