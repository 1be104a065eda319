"""Sessions, staging and the query registry."""
