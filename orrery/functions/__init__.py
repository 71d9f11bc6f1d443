"""Part of the orrery analytics engine."""
