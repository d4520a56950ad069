"""Readers and writers: FASTA, the sequence store, and the text layouts of results."""
