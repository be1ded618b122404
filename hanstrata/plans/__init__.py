"""Stage compositions and the query registry."""
