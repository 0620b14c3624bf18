"""Evidence retrieval over text corpora, expressed as Spark DataFrame plans."""
