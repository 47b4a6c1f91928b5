"""panelcast.sources."""
