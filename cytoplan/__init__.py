"""Single-cell sequencing analytics as DataFrame plans."""
