"""Column functions: text, HTML and image-header parsing."""
