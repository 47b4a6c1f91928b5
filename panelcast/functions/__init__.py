"""panelcast.functions."""
