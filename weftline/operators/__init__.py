"""Relational operators on annotation, image, audit, registry and metric tables."""
