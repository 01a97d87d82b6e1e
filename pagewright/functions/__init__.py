"""Part of pagewright; see the README."""
