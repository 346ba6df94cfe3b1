"""Text retrieval, duplicate detection, link analysis and crawl analytics on Spark DataFrames."""
