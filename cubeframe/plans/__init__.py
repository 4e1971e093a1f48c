"""The query language, its expressions and the session that runs them."""
