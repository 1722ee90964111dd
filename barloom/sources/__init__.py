"""Reading and writing bars, ticks, labels and reports."""
