"""Jobs over panels of bars: every operator takes a DataFrame keyed by (symbol, ts)."""
