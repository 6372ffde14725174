"""Readers for member exports, group files and side lists."""
