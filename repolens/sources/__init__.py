"""Scans of source trees and index tables, and the write rules of each table."""
