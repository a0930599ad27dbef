"""XXH64 of one long by plain integers, for tests."""



def xxh64_of_long(value: int, seed: int = 42) -> int:
    import xxhash

    return xxhash.xxh64_intdigest((value % 2**64).to_bytes(8, "little"), seed)


def half_of(doc_id: int | None) -> int | None:
    """The half of the trusted documents that an id falls into."""
    return None if doc_id is None else (lambda h: (h - 2**64 if h >= 2**63 else h) % 2)(xxh64_of_long(doc_id))
