"""siteweave: entity resolution and analytics for industrial sites, on Spark DataFrames."""
