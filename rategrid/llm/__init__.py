"""Operators of a training-data pipeline over document tables.

Every operator reads only the columns it is told to (``doc_id`` and ``text`` by default), so further columns of any name
pass by.  Nothing else in the library imports this package.
"""
