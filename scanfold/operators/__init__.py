"""Match, roll-up and expansion operators."""
