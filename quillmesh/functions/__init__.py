"""Part of the engine; see the README for what lives where."""
