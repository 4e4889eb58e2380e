"""Training-data operators: search, media, sharding, language, deduplication, tokens, packing, pages, licences, clusters, phrases."""
