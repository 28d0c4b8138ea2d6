"""From pattern text to automata."""
