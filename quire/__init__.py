"""quire: document-corpus retrieval and corpus cleaning as PySpark DataFrame programs."""
