"""From a configuration to a feature plan, and from there to a DataFrame."""
