"""Readers and writers of sequence, alignment, hit, annotation and taxonomy files."""
