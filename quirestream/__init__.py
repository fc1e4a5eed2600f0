"""Documents as rows, cleaning and rendering as DataFrame operators."""

__version__ = "0.1.0"
