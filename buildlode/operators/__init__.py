"""Row and column operators over the study tables."""
