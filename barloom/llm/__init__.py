"""Training-data operators: text, HTML, media and placement jobs for Spark."""
