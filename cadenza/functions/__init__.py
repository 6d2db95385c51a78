"""functions of the timed-speech engine."""
