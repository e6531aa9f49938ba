"""Residue alphabets.  Fixed values; order matters."""

#: One-letter codes of the standard residues, alphabetical.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
#: Letters that a sequence may keep.
SEQUENCE_LETTERS = "ACDEFGHIKLMNPQRSTVWYBZXUO"
GAP = "-"
