"""Where records come from: registered tables and managed datasets."""
