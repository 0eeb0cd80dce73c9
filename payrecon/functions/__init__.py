"""Part of payrecon."""
