"""Query plans: each module registers the queries of one family."""
