"""shelfmark: ranked-list analytics, entity resolution and corpus preparation on Spark."""
