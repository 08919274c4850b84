"""Part of the orrery engine."""
