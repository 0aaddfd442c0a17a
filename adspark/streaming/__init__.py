"""Change streams, incrementally maintained views and sinks."""
