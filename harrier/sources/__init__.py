"""Where indicators, lists, settings and files come from."""
