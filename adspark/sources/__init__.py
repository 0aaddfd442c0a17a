"""Record sources and sinks: both text forms, JSON and files."""
