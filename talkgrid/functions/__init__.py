"""functions of talkgrid."""
