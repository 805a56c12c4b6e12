"""Document-retrieval analytics on Spark: layout records to blocks, sections and chunks, and batches of queries over them."""
