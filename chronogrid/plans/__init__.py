"""How tables become series and cubes."""
