"""Column functions over text, URLs, vectors and samples."""
