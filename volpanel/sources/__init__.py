"""Reading, writing and staging of tables."""
