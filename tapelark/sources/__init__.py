"""Readers and writers of the store, of folders of recorded runs, and of model checkpoints."""
