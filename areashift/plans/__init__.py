"""The three end-to-end analyses, each one lazy plan over landed files."""
