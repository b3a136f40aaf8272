"""Preparation of text for language models; nothing outside this folder imports it."""
