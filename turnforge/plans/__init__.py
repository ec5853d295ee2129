"""Query plans: fixture derivations, the registered queries and their SQL oracles."""
