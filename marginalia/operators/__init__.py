"""DataFrame operators: chunking, embedding, search, selection, context, evaluation."""
