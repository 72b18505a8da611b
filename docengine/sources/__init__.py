"""Sources and sinks of documents, chunks, questions and vectors."""
