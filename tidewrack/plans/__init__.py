"""Query catalogue (queries and their SQL oracles) and the staged pipeline."""
