"""millrace: declarative curation, splitting and scoring of records on Spark."""
