"""Where data and models come from and go to."""
