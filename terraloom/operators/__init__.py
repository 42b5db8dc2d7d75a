"""DataFrame operators: retrieval, fusion, spatial work and evaluation."""
