"""Column functions: ids, names, keys, texts, vectors."""
