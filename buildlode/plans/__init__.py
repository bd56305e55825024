"""Feature building, training and end-to-end jobs."""
