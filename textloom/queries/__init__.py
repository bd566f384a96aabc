"""Queries of the library's own operators, by family. Importing a module registers its queries."""
