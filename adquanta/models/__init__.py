"""Learning to predict high performers."""
