"""Where pages come from, and which reader a URL needs."""
