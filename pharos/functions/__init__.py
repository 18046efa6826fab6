"""Part of pharos; see README.md."""
