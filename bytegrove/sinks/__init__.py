"""Text and graph outputs."""
