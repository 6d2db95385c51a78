"""sources of the timed-speech engine."""
