"""terraquill: field-campaign geo-analytics and corpus preparation on Spark DataFrames."""
