"""Training-data operators: each module holds one operator and its query.

``queries`` gathers them for the entry file; nothing else in the library
imports this subpackage.
"""
