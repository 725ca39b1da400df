"""Where rows come from: Parquet tables and the course relations derived from them."""
