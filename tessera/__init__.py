"""Analytics and data-quality jobs for content catalogues and lead streams on Spark."""
