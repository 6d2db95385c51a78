"""streaming of the timed-speech engine."""
