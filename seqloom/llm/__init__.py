"""Operators for preparing large training collections.  Nothing outside imports this subpackage."""
