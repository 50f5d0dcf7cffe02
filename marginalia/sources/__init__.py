"""Sources and sinks: files, notes, indexes, caches, dumps."""
