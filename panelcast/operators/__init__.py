"""panelcast.operators."""
