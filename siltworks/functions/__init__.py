"""Part of siltworks."""
