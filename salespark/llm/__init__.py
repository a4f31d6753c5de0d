"""Operators that prepare text corpora for training: filtering, deduplication, masking, formatting, mixing."""
