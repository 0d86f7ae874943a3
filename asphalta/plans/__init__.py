"""Domain views, star schema and end-to-end plans."""
