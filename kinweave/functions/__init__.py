"""Part of kinweave; see the README."""
