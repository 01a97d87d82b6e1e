"""Analytics over stored crawls: extraction, chunking, retrieval, cited reports - as Spark plans."""
