"""Map-only scoring of a stream with the same operators as the batch path."""
