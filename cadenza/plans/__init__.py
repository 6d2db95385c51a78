"""plans of the timed-speech engine."""
