"""Column functions: content ids, object keys, vectors and text embeddings."""
