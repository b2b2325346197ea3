"""What becomes of a matrix: manifest, imputation, sinks."""
