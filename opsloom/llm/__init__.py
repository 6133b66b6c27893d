"""Training-data operators: search, de-duplication, sampling, sharding and packing of a corpus."""
