"""Two-sample experiments as DataFrame plans."""
