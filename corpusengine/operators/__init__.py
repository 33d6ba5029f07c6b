"""DataFrame operators: retrieval, routing, chunking, linkage, memory, compaction, synchronisation, audit."""
