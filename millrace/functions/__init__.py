"""Column functions: filters over nested payloads, vectors, text, ids and other scalars."""
