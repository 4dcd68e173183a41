"""Training-data operators for large text corpora.

Nothing outside this subpackage imports it; deleting the folder leaves the rest of the library whole.
"""
