"""Personal event history on Spark: sources, canonical events, episodes, provenance, retrieval."""
