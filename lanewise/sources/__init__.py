"""Where memory logs come from: carrier views over relational tables, and lanes on disk."""
