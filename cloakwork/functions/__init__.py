"""Column-level building blocks: detectors, spans, scalar idioms, vectors."""
