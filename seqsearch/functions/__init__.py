"""Column expressions: residues, k-mers, scores and statistics of alignments."""
