"""Reading series from names, catalogues and vector files, and writing them."""
