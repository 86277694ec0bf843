"""Log entries and requests that arrive over time."""
