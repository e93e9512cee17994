"""Operators of a training-data pipeline over documents and conversations.

Nothing outside this folder imports it; ``queries.py`` lists its queries.
"""
