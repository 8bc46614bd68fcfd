"""Part of quire; see the README for the list of operators."""
