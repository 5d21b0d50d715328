"""Operators for preparing training text, apart from the rest of the library.

`queries` holds the registered questions; every other module is one operator or a small helper.
"""
