"""quillspark: document retrieval, chunking and conversation analytics on Spark DataFrames."""
