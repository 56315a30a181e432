"""Where layers and results come from and go to."""
