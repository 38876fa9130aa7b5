"""Forecasting models over all tags at once."""
