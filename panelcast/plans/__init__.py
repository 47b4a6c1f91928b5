"""panelcast.plans."""
