"""Source readers, table layouts and sinks."""
