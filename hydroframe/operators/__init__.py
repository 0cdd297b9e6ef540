"""Relational operators over signals, blocks, frames and metadata."""
