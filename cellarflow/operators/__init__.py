"""cellarflow.operators"""
