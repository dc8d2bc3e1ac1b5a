"""Scans of folder trees and of the metadata inside media files."""
