"""Streaming forms of window operators (an extension; the operators themselves are for bounded inputs)."""
