"""Wager analytics and corpus preparation as plain DataFrame functions."""
