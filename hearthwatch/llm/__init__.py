"""Training-data operators: filtering, deduplication, sampling, sharding and tokenising of document tables."""
