"""Registered queries of the deductive engine, with their SQL oracles."""
