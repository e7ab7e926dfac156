"""Plans: operators put together into whole jobs."""
