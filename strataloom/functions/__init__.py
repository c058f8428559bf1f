"""Part of the strataloom engine."""
