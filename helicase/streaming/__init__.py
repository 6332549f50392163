"""The screen over streams of alignment files."""
