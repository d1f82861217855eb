"""streaming of talkgrid."""
