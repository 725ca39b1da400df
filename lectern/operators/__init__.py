"""DataFrame to DataFrame operators of the course pipeline."""
