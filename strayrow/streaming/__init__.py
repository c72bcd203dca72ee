"""The same detection over streams of rows."""
