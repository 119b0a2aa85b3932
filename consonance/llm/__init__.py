"""Training-data operators: search, storage, near duplicates, packing, sharding, formatting, cleaning."""
