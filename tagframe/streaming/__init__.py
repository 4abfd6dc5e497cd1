"""Files as a stream: new files are parsed as they arrive, with the operators for tables."""
