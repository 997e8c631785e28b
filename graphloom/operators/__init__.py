"""Operators from DataFrame to DataFrame; all rows carry their document_id."""
