"""Where events and configuration come from."""
