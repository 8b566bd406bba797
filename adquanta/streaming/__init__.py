"""Funnels, windows and alerts over ad events, batch and streaming."""
