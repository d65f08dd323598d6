"""From formulas to staged DataFrame projections."""
