"""Reader state as structured streams."""
