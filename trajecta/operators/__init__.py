"""DataFrame operators: flat event tables, nested sessions, encodings, symbols, neighbours, metrics."""
