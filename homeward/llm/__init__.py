"""Operators of a training-data pipeline. Nothing else in the package imports this folder."""

from homeward.session import ship_package

ship_package()
