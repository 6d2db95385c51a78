"""operators of the timed-speech engine."""
