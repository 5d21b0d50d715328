"""Where records come from and where results are kept."""
