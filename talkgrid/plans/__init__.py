"""plans of talkgrid."""
