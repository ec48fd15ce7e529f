"""Part of the gridlight engine."""
