"""DataFrame operators: layout, sections, chunks, profiling, retrieval, evaluation."""
