"""operators of talkgrid."""
