"""Scans (delimited text, workbooks, landing folders) and the table/catalog store."""
