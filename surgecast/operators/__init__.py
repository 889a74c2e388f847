"""DataFrame -> DataFrame operators over one series or a panel keyed by series_cols."""
