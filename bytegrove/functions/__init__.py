"""Column functions: names, paths, globs, modifiers, signatures."""
