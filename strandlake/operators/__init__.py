"""strandlake.operators"""
