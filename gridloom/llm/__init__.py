"""Training-data pipeline operators (sharding, secrets, packing, filters, dedup, language ID ...)."""
