"""cellarflow.streaming"""
