"""Dictionaries, configuration, plugins and driver queries."""
