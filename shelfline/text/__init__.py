"""Conversation text jobs (T1-T11) as native column rules."""
