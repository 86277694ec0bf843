"""Tables, action log and snapshots in storage."""
