"""Sources of documents and graphs."""
