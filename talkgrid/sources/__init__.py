"""sources of talkgrid."""
