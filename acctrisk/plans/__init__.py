"""Feature tables, the account mart, profiles and evaluation tables."""
