"""panelcast.streaming."""
