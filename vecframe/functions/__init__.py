"""Column functions of vectors, texts and ids."""
