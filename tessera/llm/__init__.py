"""Operators for preparing large text corpora; nothing else in tessera imports this subpackage."""
