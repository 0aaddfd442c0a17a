"""Query operators over DataFrames of records."""
