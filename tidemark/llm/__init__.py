"""Operators for preparing training text: deduplication, language, packing, licences, toxicity, media.

Nothing outside this folder imports it; the folder can be deleted without harm to the rest.
"""
